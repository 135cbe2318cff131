"""Canonical exact digests: Unicode normalisation, case and whitespace folding, wide xxhash, byte comparison."""

from __future__ import annotations

import unicodedata
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import Bloom, arrow_map, lean, partitions, shared, stage, unstage
from alertmill.llm.repeats import LEAST, keyed


def canonical(text: str) -> bytes:
    """NFKC, full case folding, NFKC again, runs of whitespace as one space, none at the ends."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode()


def digest_of(form: bytes) -> int:
    return xxhash.xxh3_128_intdigest(form)


def halves(d: list[int]) -> tuple[np.ndarray, np.ndarray]:
    low = (1 << 64) - 1
    return np.array([x >> 64 for x in d], dtype=np.uint64).view(np.int64), np.array([x & low for x in d], dtype=np.uint64).view(np.int64)


def clashes(rows: DataFrame) -> Bloom:
    """Digests shared by texts whose canonical bytes differ, as a sieve; empty unless xxh3-128 has collided.

    Rows are grouped by digest; only texts in buckets of two or more are sent, compressed without loss, and the
    bytes of a bucket are compared with one another.
    """
    spark = rows.sparkSession

    def first(batch):
        hi, lo = halves([digest_of(canonical(t)) for t in batch.column("text").to_pylist()])
        return {"hi": hi, "lo": lo}

    again = stage(arrow_map(rows, "hi long, lo long", first, "text").groupBy("hi", "lo").agg(F.count("*").alias("c")).where("c > 1").select("hi"), "digests")
    sieve = shared(spark, Bloom.of(again, "hi"))

    def second(batch):
        forms = [canonical(t) for t in batch.column("text").to_pylist()]
        hi, lo = halves([digest_of(x) for x in forms])
        keep = np.flatnonzero(sieve.value.has(hi))
        press = zstandard.ZstdCompressor(level=1)
        return {"hi": hi[keep], "lo": lo[keep], "form": [press.compress(forms[i]) for i in keep]}

    # all bytes of a bucket are equal if the least and the greatest are; both combine before the shuffle
    sent = arrow_map(rows, "hi long, lo long, form binary", second, "text")
    bad = stage(sent.groupBy("hi", "lo").agg(F.min("form").alias("a"), F.max("form").alias("z")).where("a <> z").select("hi").distinct(), "clashes")
    out = Bloom.of(bad, "hi")
    unstage(again, bad)
    return out


def name_of(form: bytes, bad: Bloom) -> str:
    """The digest in hex; where different texts share it, with the SHA-256 of the bytes behind it."""
    d = digest_of(form)
    hit = bad.has(halves([d])[0])[0] if bad.words.any() else False
    return f"{d:032x}-{sha256(form).hexdigest()}" if hit else f"{d:032x}"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint): equal canonical texts, and only they, have equal fingerprints.

    A null text is the empty one; null ids and repeated rows are rows like others; very long texts are held one at a time.
    """
    rows = keyed(docs, id_col, text_col)
    bad = shared(docs.sparkSession, clashes(rows))

    def step(batch):
        texts = batch.column("text").to_pylist()
        return {"id": batch.column("id"), "n_chars": [len(t) for t in texts], "fingerprint": [name_of(canonical(t), bad.value) for t in texts]}

    out = arrow_map(rows, "id long, n_chars long, fingerprint string", step, "text")
    return out.select(F.when(F.col("id") != LEAST, F.col("id")).alias(id_col), "n_chars", "fingerprint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, first_id, copies): the class of each document; classes are counted before they are joined back."""
    found = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    heads = found.groupBy("fingerprint").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
    return found.join(heads, "fingerprint").select(id_col, "fingerprint", "first_id", "copies")


OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the start of the next document's.

    Documents are dealt by ranges of ids; the first document of a range also goes to the range before it, so each
    text crosses the network once, compressed. Likeness of exact digests is 1 for equal canonical bytes and else 0.
    Rows that repeat an id are ordered by a hash of their texts; a null id comes first; a single document is its own next.
    """
    rows = keyed(docs, id_col, text_col)
    spark = rows.sparkSession
    n = 4 * partitions(spark)
    bad = shared(spark, clashes(rows))
    cuts = rows.select(F.percentile_approx("id", [i / n for i in range(1, n)], 10000).alias("q")).first().q or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))
    dealt = rows.select("id").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.searchsorted(cuts, b.column("id").to_numpy(zero_copy_only=False), side="right"), pa.int64())], names=["id", "part"]) for b in it), "id long, part long")
    firsts = sorted((r.part, r.id) for r in dealt.groupBy("part").agg(F.min("id").alias("id")).collect())  # a row for each range
    before = {i: firsts[k - 1][0] for k, (_, i) in enumerate(firsts)}
    told = shared(spark, (cuts, before))

    def send(batch):
        cuts, before = told.value
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        press = zstandard.ZstdCompressor(level=1)
        z, h = [press.compress(t) for t in texts], [xxhash.xxh3_64_intdigest(t) >> 1 for t in texts]
        part = np.searchsorted(cuts, ids, side="right").tolist()
        ahead = [i for i, x in enumerate(ids.tolist()) if x in before]
        take = lambda x: [*x, *(x[i] for i in ahead)]
        return {"part": [*part, *(before[int(ids[i])] for i in ahead)], "look": [0] * len(z) + [1] * len(ahead), "id": take(ids.tolist()), "h": take(h), "z": take(z)}

    sent = arrow_map(rows, "part long, look int, id long, h long, z binary", send, "text").repartition(partitions(spark), "part").sortWithinPartitions("part", "look", "id", "h")
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def pairs(batches):
        clash, un = bad.value, zstandard.ZstdDecompressor()
        was = None
        for batch in batches:
            out = []
            part, look, ids, z = (batch.column(c) for c in ("part", "look", "id", "z"))
            for i in range(batch.num_rows):
                p, text = part[i].as_py(), un.decompress(z[i].as_py()).decode()
                form = canonical(text)
                if was is not None and was[0] == p:
                    out.append(row(was, text, form, clash))
                was = None if look[i].as_py() else (p, ids[i].as_py(), text, form)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    def row(was, text, form, bad):
        _, i, own, own_form = was
        k = len(own) // 4
        edited = own[: len(own) - k] + text[:k]
        new = canonical(edited)
        return i, len(own), sha256(edited.encode()).hexdigest(), name_of(own_form, bad), name_of(new, bad), float(own_form == new), float(own_form == form)

    out = sent.mapInArrow(lean(pairs), OUT)
    return out.select(F.when(F.col("id") != LEAST, F.col("id")).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op1_fingerprints(spark, sf_dir):
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
