"""Exact repeated windows of a corpus, found through anchored chunks (see ``scan.anchored_chunks``).

Equal windows share an anchor and the offset to it, so a window can only repeat where its anchor repeats. Most
repeats are whole chunks that recur, which one aggregate over chunk hashes settles; single windows are compared
only between different chunks of one anchor. Anchors and chunks go by 64-bit hashes; two chunks are only ever compared
where their anchors agree, so what can be mistaken is one of the few chunks around one anchor for another, at 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import Bloom, arrow_map, buffer_of, mix64, session, shared, stage, unstage
from alertmill.llm.scan import Rolling, anchored_chunks, covered, word_hashes, words_of

LEAST = -(1 << 63)
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def row_key(*columns: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for these long columns."""
    h = np.full(len(columns[0]), 42, dtype=np.uint64)
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    for c in columns:
        x = np.ascontiguousarray(c).astype(np.int64).view(np.uint64)
        h = h + P5 + np.uint64(8)
        h ^= rot(x * P2, 31) * P1
        h = rot(h, 27) * P1 + P4
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


@dataclass(frozen=True)
class Windows:
    """Windows of ``length`` units, anchored by pieces of ``piece`` units; a unit is a ``word`` or a ``byte``."""

    unit: str
    length: int
    piece: int

    def units(self, batch: pa.RecordBatch) -> tuple:
        buf, offs = buffer_of(batch.column("text"))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        raw = buf.tobytes()
        h = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], dtype=np.uint64).view(np.int64)
        if self.unit == "byte":
            return ids, h, buf.astype(np.uint64) + np.uint64(1), offs, raw, offs
        starts, ends, row = words_of(buf, offs)
        return ids, h, word_hashes(buf, starts, ends), np.searchsorted(row, np.arange(len(offs))), raw, (starts, ends, offs)

    def chunks(self, batch: pa.RecordBatch) -> tuple:
        ids, h, units, offs, *_ = self.units(batch)
        return ids, h, anchored_chunks(units, offs, self.length, self.piece)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with a null id as the least long and a null text as the empty one."""
    session(docs.sparkSession)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST).cast("long")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


CHUNKS = "id long, h long, s int, n int, o int, anchor long, chunk long"


def chunks(docs: DataFrame, win: Windows, sieve: Bloom | None = None, on: str = "anchor") -> DataFrame:
    """Every chunk whose ``on`` hash may be in the sieve."""
    b = sieve and shared(docs.sparkSession, sieve)

    def step(batch):
        ids, h, c = win.chunks(batch)
        if c is None:
            return None
        keep = slice(None) if b is None else b.value.has(c[on])
        r = c["row"][keep]
        return {"id": ids[r], "h": h[r], "s": c["s"][keep].astype(np.int32), "n": c["n"][keep].astype(np.int32), "o": c["o"][keep].astype(np.int32), "anchor": c["anchor"][keep].view(np.int64), "chunk": c["chunk"][keep].view(np.int64)}

    return arrow_map(docs, CHUNKS, step, "text")


def chunk_places(docs: DataFrame, win: Windows) -> DataFrame:
    """(anchor, chunk, place) of every chunk; ``place`` is what ``xxhash64(id, h, s)`` gives."""

    def step(batch):
        ids, h, c = win.chunks(batch)
        if c is None:
            return None
        r = c["row"]
        return {"anchor": c["anchor"].view(np.int64), "chunk": c["chunk"].view(np.int64), "place": row_key(ids[r], h[r], c["s"])}

    return arrow_map(docs, "anchor long, chunk long, place long", step, "text")


def contents(docs: DataFrame, win: Windows, sieve: Bloom) -> DataFrame:
    """The bytes of the chunks whose place may be in the sieve: (id, h, s, n, o, anchor, text)."""
    b = shared(docs.sparkSession, sieve)

    def step(batch):
        ids, h, _, offs, raw, _ = win.units(batch)
        c = win.chunks(batch)[2]
        if c is None:
            return None
        r = c["row"]
        keep = np.flatnonzero(b.value.has(row_key(ids[r], h[r], c["s"])))
        r, at, n = r[keep], c["at"][keep], c["n"][keep]
        ends = at + n + win.length - 1
        return {"id": ids[r], "h": h[r], "s": c["s"][keep].astype(np.int32), "n": n.astype(np.int32), "o": c["o"][keep].astype(np.int32), "anchor": c["anchor"][keep].view(np.int64), "text": pa.array([raw[a:z] for a, z in zip(at.tolist(), ends.tolist())], pa.binary())}

    return arrow_map(docs, "id long, h long, s int, n int, o int, anchor long, text binary", step, "text")


#: Windows, by their anchor's offset, that are settled together where they can be.
SEGMENT = 8


def _segments(batch: pa.RecordBatch, win: Windows) -> dict[str, np.ndarray]:
    buf, offs = buffer_of(batch.column("text"))
    roll = Rolling(buf.astype(np.uint64) + np.uint64(1))
    col = lambda k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
    n, o = col("n"), col("o")
    low, high = (o - n + 1) // SEGMENT, o // SEGMENT
    count = high - low + 1
    row = np.repeat(np.arange(len(n)), count)
    g = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
    first, last = np.maximum(SEGMENT * g, (o - n + 1)[row]), np.minimum(SEGMENT * g + SEGMENT - 1, o[row])
    j, m = o[row] - last, last - first + 1
    base = offs[:-1][row]
    core_at = base + o[row] - SEGMENT * g
    core = mix64(roll.runs(core_at, core_at - SEGMENT + 1 + win.length) ^ mix64(g.astype(np.uint64) + np.uint64(1)))
    full = mix64(roll.runs(base + j, base + j + m - 1 + win.length) ^ mix64((first << 32 | last).astype(np.uint64) + np.uint64(1)))
    ids, h, s = col("id")[row], col("h")[row], col("s")[row]
    return {"anchor": col("anchor")[row], "core": core.view(np.int64), "full": full.view(np.int64), "id": ids, "h": h, "p": (s + j).astype(np.int32), "m": m.astype(np.int32), "seg": row_key(ids, h, s, g), "at": base + j, "off": last, "roll": roll}


def segments(held: DataFrame, win: Windows) -> DataFrame:
    """Cuts chunks into segments of windows: ``core`` hashes the bytes that all windows of a segment's range hold, ``full`` all bytes of those present."""

    def step(batch):
        got = _segments(batch, win)
        return {k: got[k] for k in ("anchor", "core", "full", "id", "h", "p", "m", "seg")}

    return arrow_map(held, "anchor long, core long, full long, id long, h long, p int, m int, seg long", step, "text")


def segment_windows(held: DataFrame, win: Windows, sieve: Bloom) -> DataFrame:
    """The single windows of the segments that may be in the sieve: (id, h, p, anchor, key)."""
    b = shared(held.sparkSession, sieve)

    def step(batch):
        x = _segments(batch, win)
        keep = np.flatnonzero(b.value.has(x["seg"]))
        m = x["m"][keep].astype(np.int64)
        which = np.repeat(keep, m)
        j = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
        a = x["at"][which] + j
        key = mix64(x["roll"].runs(a, a + win.length) ^ mix64((x["off"][which] - j).astype(np.uint64) + np.uint64(1)))
        return {"id": x["id"][which], "h": x["h"][which], "p": (x["p"][which] + j).astype(np.int32), "anchor": x["anchor"][which], "key": key.view(np.int64)}

    return arrow_map(held, "id long, h long, p int, anchor long, key long", step, "text")


def distinct_chunks(found: DataFrame) -> DataFrame:
    """A row for each different chunk: its count ``c`` and its first place ``rep``."""
    return found.groupBy("anchor", "chunk", "n", "o").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "s")).alias("rep"))


def windows_of(docs: DataFrame, win: Windows, sieve: Bloom) -> DataFrame:
    """The windows of the chunks whose place may be in the sieve: (id, h, p, anchor, key)."""
    b = shared(docs.sparkSession, sieve)

    def step(batch):
        ids, h, c = win.chunks(batch)
        if c is None:
            return None
        r = c["row"]
        keep = np.flatnonzero(b.value.has(row_key(ids[r], h[r], c["s"])))
        if not len(keep):
            return None
        n = c["n"][keep]
        which = np.repeat(keep, n)
        j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        a = c["at"][which] + j
        off = c["o"][which] - j
        key = mix64(c["roll"].runs(a, a + win.length) ^ mix64(off.astype(np.uint64) + np.uint64(1)))
        return {"id": ids[r[which]], "h": h[r[which]], "p": (c["s"][which] + j).astype(np.int32), "anchor": c["anchor"][which].view(np.int64), "key": key.view(np.int64)}

    return arrow_map(docs, "id long, h long, p int, anchor long, key long", step, "text")


def _gathered(spans: DataFrame) -> DataFrame:
    # rows of one id and text give the same spans: each is gathered once, so a list is as long as its text has windows
    one = spans.distinct().groupBy("id", "h").agg(F.collect_list(F.struct("s", "n")).alias("x"))
    return stage(one.select("id", "h", F.col("x.s").alias("starts"), F.col("x.n").alias("counts")), "spans")


def spans_elsewhere(docs: DataFrame, win: Windows, table: DataFrame) -> DataFrame:
    """(id, h, starts, counts): runs of windows that also start anywhere else, by document.

    ``table`` (anchor, chunk, c, place) holds the different chunks of all anchors that occur more than once.
    Chunks that recur are settled whole. Of anchors with several chunks, segments of windows that recur are
    settled whole, segments whose common core stands alone hold no repeat, and only between those are single
    windows compared.
    """
    own = table.groupBy("anchor").agg(F.count("*").alias("nd")).where("nd > 1").select("anchor")
    places = stage(table.join(own, "anchor", "left_semi").select("place"), "places")
    held = stage(contents(docs, win, Bloom.of(places, "place")), "contents")
    unstage(places)
    segs = stage(segments(held, win), "segments")
    kinds = stage(segs.groupBy("anchor", "core", "full").agg(F.count("*").alias("c"), F.min("seg").alias("seg")), "kinds")
    again = kinds.where("c > 1").select("anchor", "core", "full")
    some = segs.join(again, ["anchor", "core", "full"], "left_semi").select("id", "h", F.col("p").alias("s"), F.col("m").alias("n"))
    open_ = kinds.groupBy("anchor", "core").agg(F.count("*").alias("nd")).where("nd > 1").select("anchor", "core")
    ask = stage(kinds.join(open_, ["anchor", "core"], "left_semi").select("seg"), "ask")
    wins = stage(segment_windows(held, win, Bloom.of(ask, "seg")), "windows")
    unstage(ask, held)
    twice = wins.groupBy("anchor", "key").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "key")
    single = wins.join(twice, ["anchor", "key"], "left_semi").select("id", "h", F.col("p").alias("s"), F.lit(1).alias("n"))
    whole = stage(table.where("c > 1").select("anchor", "chunk"), "whole")
    full = chunks(docs, win, Bloom.of(whole, "chunk"), "chunk").join(whole, ["anchor", "chunk"], "left_semi").select("id", "h", "s", "n")
    out = _gathered(some.union(single).union(full))
    unstage(segs, kinds, wins, whole)
    return out


def spans_earlier(docs: DataFrame, win: Windows, table: DataFrame) -> DataFrame:
    """(id, h, starts, counts): runs of windows whose sequence also starts at a smaller (id, h, start), by document.

    ``table`` (anchor, chunk, n, o, c, rep) holds the different chunks of all anchors that occur more than once.
    """
    own = table.groupBy("anchor").agg(F.count("*").alias("nd")).where("nd > 1").select("anchor")
    multi = table.join(own, "anchor", "left_semi").select("rep.*")
    places = stage(multi.select(F.xxhash64("id", "h", F.col("s").cast("long")).alias("k")), "places")
    wins = stage(windows_of(docs, win, Bloom.of(places, "k")), "windows")
    unstage(places)
    first = wins.groupBy("anchor", "key").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "p")).alias("f")).where("c > 1").drop("c")
    some = wins.join(first, ["anchor", "key"]).where(F.struct("id", "h", "p") > F.col("f")).select("id", "h", F.col("p").alias("s"), F.lit(1).alias("n"))
    whole = stage(table.where("c > 1").select("anchor", "chunk", "n", "o", "rep"), "whole")
    full = chunks(docs, win, Bloom.of(whole, "chunk"), "chunk").join(whole, ["anchor", "chunk", "n", "o"]).where(F.struct("id", "h", "s") > F.col("rep"))
    out = _gathered(some.union(full.select("id", "h", "s", "n")))
    unstage(wins, whole)
    return out


def remove(docs: DataFrame, win: Windows, spans: DataFrame) -> DataFrame:
    """Takes the covered units out: (id, n_units, n_removed, n_spans, kept_sha256, kept), in one shuffle of the texts that lose something.

    ``kept`` is the remaining text; of words, joined by one space.
    """
    from hashlib import sha256

    keys = spans.select(F.xxhash64("id", "h").alias("k"))
    b = shared(docs.sparkSession, Bloom.of(keys, "k"))
    words = win.unit == "word"

    def first(batch):
        ids, h, units, offs, raw, where = win.units(batch)
        maybe = b.value.has(row_key(ids, h))
        press = zstandard.ZstdCompressor(level=1)
        at = where[2] if words else where
        texts = [raw[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
        # a text that loses nothing is finished here
        done = [None if m else b" ".join(t.split()) if words else t for m, t in zip(maybe.tolist(), texts)]
        return {"id": ids, "h": h, "n_units": np.diff(offs), "sha": [None if t is None else sha256(t).hexdigest() for t in done], "z": [press.compress(t) if m else None for m, t in zip(maybe.tolist(), texts)]}

    sent = arrow_map(docs, "id long, h long, n_units long, sha string, z binary", first, "text")
    both = sent.join(spans, ["id", "h"], "left")

    def last(batch):
        out = {k: [] for k in ("n_removed", "n_spans", "kept_sha256")}
        sha, z = batch.column("sha").to_pylist(), batch.column("z")
        starts, counts, n = batch.column("starts"), batch.column("counts"), batch.column("n_units").to_pylist()
        un = zstandard.ZstdDecompressor()
        for i in range(batch.num_rows):
            removed = runs = 0
            digest = sha[i]
            if digest is None:
                text = un.decompress(z[i].as_py())
                if starts[i].is_valid:
                    gone = covered(n[i], starts[i].values.to_numpy(zero_copy_only=False).astype(np.int64), counts[i].values.to_numpy(zero_copy_only=False).astype(np.int64), win.length)
                    removed = int(gone.sum())
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = kept_of(text, gone, words)
                elif words:
                    text = b" ".join(text.split())
                digest = sha256(text).hexdigest()
            out["n_removed"].append(removed)
            out["n_spans"].append(runs)
            out["kept_sha256"].append(digest)
        return {"id": batch.column("id"), "n_units": batch.column("n_units"), **out}

    return arrow_map(both, "id long, n_units long, n_removed long, n_spans long, kept_sha256 string", last, "z")


def kept_of(text: bytes, gone: np.ndarray, words: bool) -> bytes:
    if words:
        return b" ".join(w for w, g in zip(text.split(), gone.tolist()) if not g)
    return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
