"""Each operator against a plain restatement, on rows with nulls, ties, repeated rows, empty and long texts, and extra columns."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertmill.llm import decontaminate, fingerprints, line_dedup, mixing, near_duplicates, quality, repeats, substring_dedup, suffix_index, toxicity, warc
from alertmill.llm.common import Bloom, components
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, s int, place string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(0, 90)) for _ in range(40)]
    long = words(rng, 9000, 100000)
    out = [*base, long, "", None, "é" * 300, "a" * 900, "ab " * 400, base[3], base[3], base[5][:200], "  \n\t ", "one", "one", "two words"]
    shared = words(rng, 45)
    out += [words(rng, 20) + " " + shared + " " + words(rng, 20) for _ in range(6)]
    out += [(lambda w: " ".join(w[:i] + ["edit"] + w[i + 1 :]))(base[7].split() + shared.split()) for i in range(0, 60, 7)]
    out += ["line one is here and long enough\nsecond line of text goes here\n\n" + x for x in ("line one is here and long enouGh", "second line of texts goes here", "ünïcode line wîth äccents hére", "ünïcode line wîth äccents here")]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), 7, "x", 3, "p") for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def odd(docs):
    """A null id, and a row twice."""
    one = docs.where("doc_id = 3")
    return docs.unionByName(one).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))


def test_row_key_is_sparks_hash(spark):
    v = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, (50, 3), dtype=np.int64)
    got = spark.createDataFrame([tuple(map(int, r)) for r in v], "a long, b long, c long").select("a", "b", "c", F.xxhash64("a", "b", "c").alias("h")).toPandas()
    assert (repeats.row_key(got.a.to_numpy(), got.b.to_numpy(), got.c.to_numpy()) == got.h.to_numpy()).all()


def test_bloom_misses_nothing(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    b = Bloom.of(keys, "k")
    have = keys.toPandas().k.to_numpy()
    other = spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("k")).toPandas().k.to_numpy()
    assert b.has(have).all() and b.has(other).mean() < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 50)]
    s = brute.Sets()
    for a, b in edges:
        s.join(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: s.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup(docs, texts, nothing):
    for length in (20, 6):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_windows(docs, window=length).collect()}
        assert got == brute.windows_earlier(texts, length)
    assert substring_dedup.dedup_windows(nothing).count() == 0
    twice = substring_dedup.dedup_windows(odd(docs)).where("doc_id = 3 or doc_id is null").collect()
    assert len(twice) == 3 and len({r for r in twice if r.doc_id == 3}) == 1


def test_levels_double_until_none_is_left(spark, docs, monkeypatch):
    assert substring_dedup.levels(20) == [5, 10, 20] and substring_dedup.levels(100) == [4, 7, 13, 25, 50, 100] and substring_dedup.levels(1) == [1]
    seen, real = [], substring_dedup.candidates
    monkeypatch.setattr(substring_dedup, "candidates", lambda rows, win, before: seen.append((win.piece, win.length)) or real(rows, win, before))
    rows = repeats.keyed(docs, "doc_id", "text")
    win, _ = substring_dedup.survivors(rows, 20)
    assert seen == [(5, 10), (10, 20)] and (win.piece, win.length) == (10, 20)
    seen.clear()
    alone = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(60))), (2, " ".join(f"b{i}" for i in range(60)))], "doc_id long, text string")
    assert substring_dedup.survivors(repeats.keyed(alone, "doc_id", "text"), 20) is None and seen == [(5, 10)]
    assert {r.n_removed for r in substring_dedup.dedup_windows(alone).collect()} == {0}


def test_suffix_index(docs, texts, nothing):
    for length in (200, 40):
        got = [tuple(r) for r in suffix_index.dedup_bytes(docs, window=length).collect()]
        assert sorted(got, key=str) == brute.bytes_elsewhere(texts, length)
    assert suffix_index.dedup_bytes(nothing).count() == 0
    rows = odd(docs)
    got = [tuple(r) for r in suffix_index.dedup_bytes(rows, window=40).collect()]
    assert sorted(got, key=str) == brute.bytes_elsewhere([(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()], 40)


def test_suffix_index_levels(spark, docs, tmp_path):
    """Levels merge geometrically, scans and merges neither shuffle nor sort, and a kept index goes on where it was."""
    rows = repeats.keyed(docs, "doc_id", "text")
    batch = lambda b: rows.where(F.pmod("id", F.lit(5)) == b)
    index = suffix_index.SuffixIndex(spark, 40, 30)
    kept = suffix_index.SuffixIndex(spark, 40, 30, str(tmp_path / "index"))
    sizes = []
    for b in range(5):
        index.add(batch(b))
        sizes.append([n for n, _ in index.levels])
        kept.add(batch(b))
        if b == 2:
            with suffix_index.ordered(spark):
                plan = kept.scan(kept.levels[0][1], kept.levels[1][1])._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        kept = suffix_index.SuffixIndex(spark, 1, 1, str(tmp_path / "index"))  # as a later session would
        assert [n for n, _ in kept.levels] == sizes[-1] and kept.win == index.win
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    whole = suffix_index.SuffixIndex(spark, 40, 30)
    whole.add(rows)
    want = sorted(map(tuple, whole.repeated().select("anchor", "chunk", "c").collect()))
    assert want and all(sorted(map(tuple, x.repeated().select("anchor", "chunk", "c").collect())) == want for x in (index, kept))
    for x in (index, kept, whole):
        x.close()
    assert not (tmp_path / "index").exists()


def test_fingerprints(docs, texts, nothing):
    canon = {i: fingerprints.canonical(t or "") for i, t in texts}
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    ids = sorted(canon)
    by_id = {i: t or "" for i, t in texts}
    for a, b in zip(ids, [*ids[1:], ids[0]]):
        own, nxt, r = by_id[a], by_id[b], got[a]
        k = len(own) // 4
        edited = own[: len(own) - k] + nxt[:k]
        assert (r.n_chars, r.edited_sha256) == (len(own), sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(canon[a] == fingerprints.canonical(edited)) and r.near_next == float(canon[a] == canon[b])
        assert (r.fingerprint == r.edited_fingerprint) == bool(r.near_edited)
    assert len({r.fingerprint for r in got.values()}) == len(set(canon.values()))
    assert fingerprints.edited_fingerprints(nothing).count() == 0 and fingerprints.groups(nothing).count() == 0
    assert fingerprints.edited_fingerprints(odd(docs)).count() == len(texts) + 2
    g = {r.doc_id: r.copies for r in fingerprints.groups(docs).collect()}
    assert g[3] == 3
    assert fingerprints.canonical("Ａ  ﬁ STRASSE\n") == fingerprints.canonical("a fi straße")


def test_single_document_is_its_own_next(spark):
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    r = fingerprints.edited_fingerprints(one).first()
    assert r.edited_sha256 == sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


def test_clash_is_found(spark, monkeypatch):
    rows = repeats.keyed(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z z")], "doc_id long, text string"), "doc_id", "text")
    monkeypatch.setattr(fingerprints, "digest_of", lambda form: 5)
    assert fingerprints.clashes(rows).words.any()


def test_near_duplicates(docs, texts, nothing):
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == brute.near(texts)
    assert near_duplicates.near_duplicates(nothing).count() == 0
    rows = odd(docs)
    assert near_duplicates.near_duplicates(rows).count() == rows.count()
    kept = near_duplicates.one_of_each(rows)
    assert kept.columns == rows.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == len({c for c, _ in brute.near(texts).values() if c != 4}) + 1


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A component of several blocks: every link counted once, one class."""
    rng = random.Random(9)
    base = words(rng, 120).split()
    rows = [(i, " ".join(base[:j] + [f"e{i}"] + base[j + 1 :])) for i in range(60) for j in [rng.randrange(120)]] + [(99, words(rng, 50))]
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)


def test_banding_reaches_recall():
    for t, r in ((0.8, 0.9995), (0.8, 0.995), (0.5, 0.9), (1.0, 0.9)):
        bands, rows = near_duplicates.banding(t, r)
        assert 1 - (1 - t**rows) ** bands >= r - 1e-9 and bands * rows <= 128


def test_line_dedup(docs, texts, nothing):
    rows = texts
    got = {r.doc_id: (r.n_lines, r.kept) for r in line_dedup.dedup_lines(docs, carry=["lang", "h"]).collect()}
    want = brute.lines(rows)
    assert {i: k for i, (_, k) in got.items()} == want
    assert all(got[i][0] == (t or "").count("\n") + 1 for i, t in rows)
    assert line_dedup.dedup_lines(nothing).count() == 0 and line_dedup.dedup_lines(odd(docs)).count() == docs.count() + 2


@pytest.mark.parametrize("block", [512, 4])
def test_line_dedup_in_a_full_bucket(spark, monkeypatch, block):
    """All lines in one bucket: similar ones meet though its least and greatest lines resemble neither."""
    monkeypatch.setattr(line_dedup, "BUCKET", block, raising=False)
    real = line_dedup.signatures
    monkeypatch.setattr(line_dedup, "signatures", lambda *a: real(*a).withColumn("bands", F.lit(bytes(line_dedup.KEY))))
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60))
    lines = [w + x for w in (word() for _ in range(15)) for x in ("", "!")] + [word() for _ in range(6)]
    rows = list(enumerate(lines))
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i < 30 and i % 2 == 1) for i, _ in rows}


def test_line_dedup_by_the_first_line_of_a_group(spark, monkeypatch):
    """Lines that are all near their group's first are not compared with one another; a chain of lines still is one group."""
    sets = [np.unique(np.random.default_rng(i).integers(0, 60, 40).astype(np.uint64)) for i in range(9)]
    assert line_dedup.shared_with_first(sets).tolist() == [len(np.intersect1d(sets[0], x)) for x in sets[1:]]
    words = "the quick brown fox jumps over the lazy dog while seven bright owls watch quietly from old pines near water".split()
    copies = spark.createDataFrame([(i, " ".join([*words, f"n{i:02d}"])) for i in range(9)], "doc_id long, text string")
    want = brute.lines([(r.doc_id, r.text) for r in copies.collect()])
    chain = [(i, " ".join([f"{w}{'xyz'[i % 3] * 3}{i}" if k // 2 < i else w for k, w in enumerate(words)])) for i in range(7)]

    def kept(df):
        return {r.doc_id: r.kept for r in line_dedup.dedup_lines(df).collect()}

    assert kept(spark.createDataFrame(chain, "doc_id long, text string")) == brute.lines(chain)

    def never(*args):
        raise AssertionError("all pairs were compared")

    monkeypatch.setattr(line_dedup, "overlaps", never)
    monkeypatch.setattr(line_dedup, "forest", never)
    assert kept(copies) == want and sum(map(bool, want.values())) == 1


def test_line_dedup_of_repeated_ids(spark):
    """Rows that repeat an id with other texts are documents of their own; equal rows are one."""
    one, two = "first line of this text is long", "quite another second line here"
    rows = [(1, f"{one}\n{two}"), (1, f"{one}\n{two}"), (1, one), (None, two), (2, two), (3, one + "s")]
    got = sorted(((r.doc_id or 0, r.n_lines, r.n_removed, r.kept) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    kept = [k for *_, k in got]
    assert len(got) == 6 and "\n".join(kept).count(two) == 1 and (0, 1, 0, two) in got and (2, 1, 1, "") in got and (3, 1, 1, "") in got
    assert [g for g in got if g[0] == 1 and g[1] == 2][0] == [g for g in got if g[0] == 1 and g[1] == 2][1]


def test_line_dedup_of_texts_whose_short_hashes_meet(spark):
    """Two texts of one id that 32 bits of a hash do not tell apart: the line that only one has stays."""
    import xxhash

    rng, seen, pair = random.Random(1), {}, None
    while pair is None:
        unique = f"a wholly unique sentence {rng.getrandbits(48):x}"
        text = f"this line stands in both texts and is long\n{unique}"
        pair = (seen[h], text) if (h := xxhash.xxh3_64_intdigest(text) >> 32) in seen and seen[h] != text else None
        seen[h] = text
    rows = [(5, pair[0]), (5, pair[1]), (1, pair[0].split("\n")[0] + "\n" + "q" * 40)]
    got = {r.kept for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.95).collect()}
    assert {x.split("\n")[1] for x in pair} <= {k for k in got}


def test_many_equal_rows(spark):
    """Very many rows of one text without an id: what is gathered and compared is one row's, whatever their number."""
    n, text = 40_000, "\n".join(sha256(bytes([i])).hexdigest() for i in range(8))
    same = spark.range(n).selectExpr("cast(null as long) as doc_id", f"'{text}' as text".replace("\n", "\\n"))
    got = line_dedup.dedup_lines(same).groupBy("n_lines", "n_removed").count().collect()
    assert [(r.n_lines, r.n_removed, r["count"]) for r in got] == [(8, 0, n)]
    got = suffix_index.dedup_bytes(same).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r["count"]) for r in got] == [(len(text), len(text), 1, n)]


def test_line_dedup_deals_texts_at_every_size(docs):
    """Small tables too: texts that lose lines meet their lists by a shuffle, so the shuffle grows in proportion."""
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("common", [0, 120])
def test_line_dedup_recall(spark, common):
    """2,500 pairs just over the threshold, with and without boilerplate that makes all lines alike."""
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz"
    boiler, lines = "".join(rng.choices(letters, k=common)), []
    for _ in range(2500):
        own = "".join(rng.choices(letters, k=100))
        n = common + len(own) - 4
        d = int(n / 9 - 1e-9)  # shingles that an appended tail changes on one side: n / (n + d) >= 0.8
        lines += [boiler + own, boiler + own + "".join(rng.choices(letters, k=2 * d - 4))]
    rows = list(enumerate(lines))
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    grams = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    due = [i for i in range(0, len(lines), 2) if brute.jaccard(grams(lines[i]), grams(lines[i + 1])) >= 0.8]
    assert len(due) > 2000 and sum(got[i + 1] for i in due) >= 0.995 * len(due)


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta eta theta"), (1, "Ünï cödé, four words"), (2, None), (3, ""), (4, "solo"), (0, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    more = [(900, "x " * 3000 + "Alpha, BETA gamma delta epsilon zeta eta theta!" + " y" * 3000), (901, "alpha beta gamma delta epsilon zeta eta"), (902, "alpha beta gamma delta nothing zeta eta theta"), (903, "das ünï cödé four words hier"), (904, "go solo now"), (905, None)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contained(rows, items).collect()}
    assert got == {(900, 0): (4, 4), (903, 1): (1, 1), (904, 4): (1, 1)}
    looser = {(r.doc_id, r.item_id) for r in decontaminate.contained(rows, items, threshold=0.75).collect()}
    assert looser == {(900, 0), (901, 0), (903, 1), (904, 4)}
    assert decontaminate.contained(nothing, items).count() == 0 and decontaminate.contained(rows, items.limit(0)).count() == 0


def test_decontamination_of_null_ids(spark):
    items = spark.createDataFrame([(None, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "so alpha beta gamma delta epsilon zeta"), (7, "one two three four five six seven"), (8, "Alpha beta gamma delta epsilon zeta one two three four five six"), (9, "alpha beta gamma delta epsilon"), (9, "beta gamma delta epsilon zeta")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, items).collect()} == {(None, None), (7, 1), (8, None), (8, 1), (9, None)}  # rows of one id are taken together


def test_sketches_decide_the_candidates(spark):
    """Sketches have one length in a size partition, and a match holds as many values as ``need`` says."""
    rng = random.Random(4)
    items = spark.createDataFrame([(i, words(rng, n + 4, 10**6)) for i, n in enumerate((1, 2, 3, 5, 7, 12, 15, 40, 63))], "item_id long, text string")
    rows = decontaminate.item_shingles(items, "item_id", "text", 5, 0.8).toPandas()
    for _, own in rows.groupby("item_id"):
        n, k = len(own), int(own.in_sig.sum())
        most = 2 ** n.bit_length() - 1
        assert k == min(int(0.2 * most + 1e-9) + 1 + decontaminate.SPARE, n) and (own.need == max(1, k - int(0.2 * n + 1e-9))).all()
        assert own[own.in_sig].h.max() <= own[~own.in_sig].h.min() if k < n else True


def test_decontamination_past_its_bounds(spark, docs, monkeypatch):
    items = docs.where("doc_id in (5, 9, 12)").select(F.col("doc_id").alias("item_id"), "text")
    want = {tuple(r) for r in decontaminate.contained(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "IN_SCAN", 0)
    assert {tuple(r) for r in decontaminate.contained(docs, items).collect()} == want and want


def test_targets(spark):
    rng = random.Random(6)
    for n in (0, 1, 3, 40):
        rows = [(None if i == 2 else f"s{i:02}", rng.randrange(0, 200) if i % 5 else rng.randrange(0, 5000)) for i in range(n)]
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
        want = brute.share_out([x for _, x in order], [(1, 2, 3)[i % 3] for i in range(n)], 3)
        got = {r.source: r.target for r in mixing.targets_of(spark.createDataFrame(rows, "source string, size long").repartition(3), (1, 2, 3), 3).collect()}
        assert len(got) == n and all(abs(got[s] - t) < 1e-6 for (s, _), t in zip(order, want))


def test_flow_is_the_cheapest():
    rng = random.Random(2)
    for _ in range(6):
        patterns = [(m, rng.randrange(0, 3)) for m in (["a"], ["a", "b"], ["b"])]
        targets = {"a": rng.randrange(0, 7), "b": rng.randrange(0, 7)}
        given, flows = mixing.route([(str(i), m, 1, w) for i, (m, w) in enumerate(patterns)], {k: float(x) for k, x in targets.items()}, 3)
        cost = sum(c * c * min(w, max(0, given[str(i)] - c * w)) for i, (_, w) in enumerate(patterns) for c in range(3))
        assert (sum(flows.values()), cost) == brute.cheapest(patterns, targets, 3)


def test_mixing(docs, texts, nothing):
    rows = odd(docs)
    got = mixing.mixed(rows).toPandas()
    size = {i: len((t or "").encode().split()) for i, t in texts}
    assert len(got) == rows.count() and all(size[int(i)] == n for i, n in zip(got.doc_id.fillna(4), got["size"]))
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), total=("source_size", "first"), size=("size", "sum"))
    assert (by.total == by["size"]).all() and (by.target <= 3 * by.total + 1e-6).all() and abs(by.target.sum() - by.total.sum()) < 1e-6
    assert (got.taken <= 3 * got["size"]).all()
    large = got[got.source.isna() & (got["size"] > 1000)]["size"].max()  # the null source has one text of 9,000 words: half or all of its gap
    assert (abs(by.taken - by.target)[:-1] <= np.maximum(5, 0.01 * by.target[:-1])).all() and abs(by.taken - by.target).iloc[-1] <= large / 2
    again = mixing.mixed(rows.repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.mixed(nothing).count() == 0


def test_mixing_of_equal_rows(spark, monkeypatch):
    """A third of all rows share a null id; they are told apart, and the last bin stays small."""
    monkeypatch.setattr(mixing, "COPIES", 7)
    monkeypatch.setattr(mixing, "BIN", 4)
    rows = [(None if i % 3 == 0 else i, "a b c", "x" if i % 2 else "y") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.count("*").alias("n")).collect()
    assert all(abs(r.t - r.g) < 4 and r.n == 300 for r in sums)


def test_overlapping_sources(spark):
    """The cheapest flow takes from shared documents what the small source alone cannot give."""
    given, flows = mixing.route([("a", ["a"], 10, 100), ("ab", ["a", "b"], 5, 60), ("b", ["b"], 1, 10)], {"a": 85.0, "b": 85.0}, 3)
    assert sum(n for (_, s), n in flows.items() if s == "a") == 85 and sum(n for (_, s), n in flows.items() if s == "b") == 85
    assert given["ab"] == 60 and given["b"] == 10 + 15 or given["b"] + given["ab"] == 85
    rows = spark.createDataFrame([(i, ["a"] if i % 3 else ["a", "b"], 10) for i in range(90)], "doc_id long, m array<string>, n int")
    chosen, plan = mixing.mix(rows, "doc_id", F.col("m"), F.col("n"), weights=(1, 1))
    assert chosen.count() == 90 and abs(chosen.agg(F.sum("taken")).first()[0] - plan.sources.agg(F.sum("target")).first()[0]) <= 20
    flows = {(r.pattern, r.source): r.words for r in plan.flows.collect()}
    assert {s for _, s in flows} == {"a", "b"} and plan.patterns.agg(F.sum("given")).first()[0] == sum(flows.values())


def labelled(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 3 == 0
        text = words(rng, 40)
        text = " ".join(w.upper() + "!!" for w in text.split()) + " buy now" if bad else text
        rows.append((i, text + (" you vile fool" if toxic else ""), "en", "s", len(text)))
        marks.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "plain text", "en", "s", 10), (0, "again", "en", "s", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality(spark, nothing):
    docs, marks = labelled(spark)
    model = quality.train(docs, marks.where("doc_id % 5 <> 1"))
    got = quality.score(docs, model)
    assert got.count() == docs.count() and set(got.columns) == {"doc_id", "p_text", "p_page", "quality"}
    right = got.withColumnRenamed("quality", "score").join(marks.where("doc_id % 5 = 1"), "doc_id").select(((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.95 and min(model.exchanged) > 0
    odd_names = docs.withColumns({"row": F.lit(1), "_row": F.lit(2), "row_": F.lit(3), "t": F.lit(4), "y": F.lit(5)})
    assert sorted(quality.good_ones(odd_names, model).columns) == sorted(odd_names.columns)
    kept = quality.good_ones(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.where("quality >= 0.5").count()
    assert quality.score(nothing, model).count() == 0
    none = quality.train(docs, marks.limit(0))
    assert quality.good_ones(docs, none).count() == docs.count()


def test_pool_takes_all_documents(spark):
    """Every document without a label is offered, in any split, and the sums are those of a plain loop."""
    docs, marks = labelled(spark)
    few = marks.where("doc_id < 60")
    n = quality.train(docs, few).exchanged
    assert n == quality.train(docs.repartition(7), few).exchanged and max(n) > 100
    rng = np.random.default_rng(1)
    t, page = rng.normal(size=(50, 134)).astype(np.float32), docs.select(*[F.lit(i).cast(k).alias(c) for i, (c, k) in enumerate((("source", "int"), ("lang", "int"), ("n_chars", "long"), ("n_lines", "long")))]).limit(50)
    view = lambda d, b: quality.View(quality.Logistic(np.zeros(d, np.float32), np.ones(d, np.float32), rng.normal(size=d).astype(np.float32), b), 1.0, 0.0)
    views = [view(134, 0.0), view(84, 0.0)]
    rows = [(x.tobytes(), *map(int, r)) for x, r in zip(t, page.collect())]
    (first, _), _ = quality.pooled(spark.createDataFrame(rows, "t binary, source int, lang int, n_chars long, n_lines long").repartition(3), views, 0.5)
    z = np.hstack([t, np.ones((50, 1))]).astype(float)
    import pyarrow as pa

    other = views[1].p(quality.page_view(pa.RecordBatch.from_pylist([dict(zip(("source", "lang", "n_chars", "n_lines"), r[1:])) for r in rows]))) >= 0.5
    p = views[0].p(t)
    assert first.weight == 50 and np.allclose(first.g, z.T @ (p - other), atol=1e-3) and np.allclose(first.h, (z * (p * (1 - p))[:, None]).T @ z, atol=1e-3)


def test_quality_fits_on_executors(spark, monkeypatch):
    """No features and no sums of the pool but one row reach the driver; models come from the executors."""
    from pyspark.sql.classic.dataframe import DataFrame

    docs, marks = labelled(spark)
    seen = []

    def spied(name, bytes_of):
        real = getattr(DataFrame, name)

        def run(self, *args):
            out = real(self, *args)
            seen.append((name, bytes_of(out)))
            return out

        monkeypatch.setattr(DataFrame, name, run)

    spied("toArrow", lambda t: t.nbytes)
    spied("collect", lambda rows: sum(len(v) if isinstance(v, (bytes, bytearray)) else 8 for r in rows for v in r))
    model = quality.train(docs.repartition(7), marks)
    pool = spark.range(40).select(F.lit(np.zeros(134, np.float32).tobytes()).alias("t"), F.lit(0).alias("source"), F.lit(0).alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit(1).cast("long").alias("n_lines"))
    quality.pooled(pool.repartition(7), [model.text, model.page], 0.5)
    quality.pooled(pool.limit(0), [model.text, model.page], 0.5)
    one = 8 * sum(2 + d + d * d for d in (135, 85))
    assert max(n for name, n in seen if name == "toArrow") <= 16 * marks.count() and max(n for name, n in seen if name == "collect") <= one


def test_samples_are_bounded(spark):
    from alertmill.llm.samples import bounded

    docs = spark.createDataFrame([(1, "a")] * 50 + [(1, "b")] * 50 + [(2, "c"), (3, "d"), (None, "e")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = bounded(docs, marks, "doc_id", ["quality"], 10).collect()
    assert sorted(r.id for r in got) == [1, 2] and len(bounded(docs, marks, "doc_id", ["quality"], 1).collect()) == 1


def test_toxicity(spark, nothing):
    docs, marks = labelled(spark)
    chain = toxicity.train(docs, marks.where("doc_id % 5 <> 1"), toxicity.CATEGORIES)
    got = toxicity.score(docs, chain)
    test = got.join(marks.where("doc_id % 5 = 1"), "doc_id").toPandas()
    assert ((test.p_toxic >= 0.5) == (test.toxic == 1)).mean() > 0.95 and ((test.p_low_quality >= 0.5) == (test.quality == 0)).mean() > 0.95
    assert got.count() == docs.count() and toxicity.score(nothing, chain).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, marks.limit(0), toxicity.CATEGORIES)).where("p_toxic >= 0.5").count() == 0


def test_chain_learns_from_out_of_fold_probabilities():
    """Labels are noise, the second category is the first: in-sample probabilities would tell it, those out of fold do not."""
    rng = np.random.default_rng(8)
    x, y = (rng.random((80, 300)) < 0.3).astype(np.float32), (rng.random(80) < 0.5).astype(float)
    chain = toxicity.fit_chain(["a", "b"], np.arange(300, dtype=np.uint64), x, np.stack([y, y], axis=1), np.arange(80) % 5)
    seen = toxicity.fit(np.hstack([x, chain.models[0].score(x)[:, None].astype(np.float32)]), y, ridge=1e-4, standard=False, steps=400)
    assert chain.models[1].w[-1] < 0.2 * seen.w[-1]


def test_warc_round_trip(spark, tmp_path):
    page = '<html><head><title>T &amp; U</title><script>var x="</p>"</script></head><body><!-- no --><p>One<br>two</p><p title="a>b">Three &eacute;<a href="/x">link</a><a href=\'/x\'>again</a></body>'
    pages = spark.createDataFrame([(1, "http://e.org/1", page), (2, None, None), (3, "http://e.org/3", ""), (None, "u", "plain < text"), (1, "http://e.org/1", page)], "page_id long, url string, html string")
    responses = warc.responses_of(pages)
    records = warc.derive(responses)
    rows = records.collect()
    assert len(rows) == 10 and {r.type for r in rows} == {"metadata", "conversion"}
    ids = {r.record_id for r in responses.collect()}
    assert {r.refers_to for r in rows} == ids and len(ids) == 4
    text = next(r for r in rows if r.key == 1 and r.type == "conversion")
    assert bytes(text.block).decode() == "One\ntwo\nThree élinkagain" and text.block_digest == warc.digest(bytes(text.block))
    meta = next(r for r in rows if r.key == 1 and r.type == "metadata")
    block = bytes(meta.block).decode()
    assert meta.concurrent_to == text.record_id and "title: T & U\r\n" in block and "sourceHeader: Content-Type: text/html; charset=utf-8\r\n" in block and block.count("outlink: /x\r\n") == 1
    for r in rows:
        d = r.asDict()
        d.pop("key")
        d["block"] = bytes(d["block"])
        (back,) = warc.parse(warc.to_bytes(d))
        assert back == d
    warc.write(records.drop("key"), str(tmp_path / "out"))
    members = [bytes(r.member) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc.gz").write_bytes(b"".join(members))
    again = warc.read(spark, str(tmp_path / "f"))
    assert sorted(r.record_id for r in again.collect()) == sorted(r.record_id for r in rows)
    assert warc.derive(warc.responses_of(pages.limit(0))).count() == 0


def test_warc_of_a_crawl(spark, tmp_path):
    """``derive(read(...))``: charset, chunks and compression are undone, source digests and identifiers kept, odd lines passed over."""
    import gzip

    def record(kind, rid, block, *more):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Target-URI: http://e.org/", "WARC-Date: 2024-01-01T00:00:00Z", "a line without a colon", *more, f"Content-Length: {len(block)}"])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    latin = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nodd\r\n\r\n<title>T</title><p>caf\xe9</p>"
    packed = gzip.compress("<p>größer</p>".encode())
    chunks = b"%x\r\n%s\r\n%x\r\n%s\r\n0\r\n\r\n" % (5, packed[:5], len(packed) - 5, packed[5:])
    other = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    data = record("warcinfo", "<i>", b"x") + record("response", "<a>", latin, "WARC-Payload-Digest: sha1:ABC") + record("response", "<b>", other)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(data)
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(record("response", "<c>", latin)) + gzip.compress(record("response", "<d>", latin))[:60])
    read = warc.read(spark, str(tmp_path / "w"))
    assert sorted(r.record_id for r in read.collect()) == ["<a>", "<b>", "<c>", "<i>"]
    got = {(r.refers_to, r.type): r for r in warc.derive(read).collect()}
    assert len(got) == 6 and bytes(got["<a>", "conversion"].block).decode() == "café" and bytes(got["<b>", "conversion"].block).decode() == "größer"
    assert got["<a>", "metadata"].payload_digest == "sha1:ABC" and got["<b>", "metadata"].payload_digest == warc.digest(chunks)
    assert b"sourceHeader: odd\r\n" in bytes(got["<a>", "metadata"].block) and got["<a>", "metadata"].concurrent_to == got["<a>", "conversion"].record_id


@pytest.mark.parametrize("part", ["<!--", "<script>", "<template>", "<title>", "<a href=", "<a href='x ", "<p \"", "</script ", "<a " + "href " * 50])
def test_hostile_pages_take_linear_time(part):
    import time

    page = part * (2_000_000 // len(part))
    began = time.perf_counter()
    warc.derivatives({"record_id": "r", "target_uri": None, "date": None, "http_headers": None, "payload": page.encode()})
    assert time.perf_counter() - began < 5


def test_unclosed_elements():
    assert warc.page_text("x<script>\nvar a=1; alert(2)") == "x" and warc.page_text("<head><p>kept") == "kept" and warc.page_text("a <!-- b") == "a"
    assert warc.page_text("<noscript>n</noscript><td>a<td>b<li>c") == "a b\nc" and warc.page_title("<title>never closed") == ""


def test_warc_bodies_of_several_members():
    import gzip
    import zlib

    one, two = b"<p>one</p>" * 300_000, "<p>größer</p>".encode()
    assert warc.unpacked(gzip.compress(one) + gzip.compress(two)) == one + two
    assert warc.unpacked(gzip.compress(one) + gzip.compress(two) + b"\0" * 9) == one + two
    assert warc.unpacked(zlib.compress(two)) == two and warc.unpacked(zlib.compress(two)[2:-4]) == two
    assert warc.unpacked(gzip.compress(b"")) == b"" and warc.unpacked(b"") == b"" and warc.unpacked(two) == two
    cut = gzip.compress(bytes(range(256)) * 9)[:-30]
    assert (bytes(range(256)) * 9).startswith(warc.unpacked(cut)) and warc.unpacked(cut)
    bomb = gzip.compress(b"a" * (1 << 22))
    assert warc.unpacked(bomb, 1 << 21) == bomb and len(warc.unpacked(bomb, 1 << 22)) == 1 << 22
    head = "HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=utf-8"
    assert warc.markup_of(head, gzip.compress(one[:10]) + gzip.compress(two)) == "<p>one</p><p>größer</p>"


def test_mixing_goes_through_its_flow(docs, monkeypatch):
    def none(*_):
        raise RuntimeError("no flow")

    monkeypatch.setattr(mixing, "route", none)
    with pytest.raises(Exception, match="no flow"):
        mixing.mixed(docs).count()


def test_components_set_whole_ones_aside(spark, monkeypatch):
    """Pairs are done after a round: the rounds that a long path takes carry the path, not the pairs."""
    from alertmill.llm import common

    rows, plain = [], common.stage

    def counted(df, name, by=None):
        out = plain(df, name, by)
        if name == "cc":
            rows.append(out.count())
        return out

    monkeypatch.setattr(common, "stage", counted)
    pairs = [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(1000)]
    path = [((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs + path, "a long, b long")).collect()}
    assert got == {**{x: a for a, b in pairs for x in (a, b)}, **dict.fromkeys(range(101), 0)}
    assert len(rows) > 4 and rows[:2] == [2101, 2101] and set(rows[2:]) == {101}
