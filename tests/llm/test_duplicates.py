"""Near-duplicates, line dedup, decontamination and the pipeline against brute force."""

import collections
import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOCS, clashing, components, edge_rows, family_rows, prose, words

from tessel.llm import buckets, decontaminate, line_dedup, near_dup
from tessel.llm.shingles import NOT_WORD, MinHash, word_hashes
from tessel.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.mark.parametrize(("width", "percent"), [(2, 80), (5, 80)])
def test_near_duplicates_as_all_pairs(spark, width, percent):
    rows = edge_rows() + [(r[0] + 500, *r[1:]) for r in family_rows(50, seed=width)]
    got = near_dup.near_duplicates(clashing(spark.createDataFrame(rows, DOCS)).repartition(6), width, percent).collect()
    want = components(rows, width, percent)
    low = -(10**30)
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    for r in got:
        root = want[low if r["doc_id"] is None else r["doc_id"]]
        assert r["component_id"] == (None if root == low else root)
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_edges(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "same text of some few words here", "en", "s", 0) for i in range(300)] + [(1000 + i, None, "en", "s", 0) for i in range(3)]
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()}
    assert all(got[i]["component_id"] == 0 for i in range(300))
    assert all(got[i]["kept"] and got[i]["n_shingles"] == 0 for i in (1000, 1001, 1002))


def test_one_document_of_each_group_stays(spark):
    rows = edge_rows() + [(r[0] + 500, *r[1:]) for r in family_rows(30, seed=11)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    out = near_dup.drop_near_duplicates(df)
    assert out.columns == df.columns
    low = -(10**30)
    want = components(rows, 5, 80)
    kept = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert kept == sorted((None if i == low else i for i, root in want.items() if i == root), key=str)


def test_documents_that_share_an_id_or_have_none(spark):
    rng = random.Random(31)
    a, b, c, d, e, f = (prose(rng, 60, 10**6) for _ in range(6))
    near = lambda t: " ".join(t.split()[:59])
    rows = [(None, a), (None, b), (None, b), (None, near(b)), (None, None), (None, ""), (5, c), (5, d), (5, d.upper()), (6, near(c)), (7, near(d)), (8, near(a)), (9, e), (9, near(e)), (10, f)]
    df = clashing(spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)).repartition(4)
    groups = {t.split()[0]: t for t in (a, b, c, d, e, f)}
    first = {a: None, b: None, c: 5, d: 5, e: 9, f: 10}
    for r in near_dup.near_duplicates(df).where("n_shingles > 0 and doc_id >= 6").collect():
        assert r["component_id"] == {6: 5, 7: 5, 8: None, 9: 9, 10: 10}[r["doc_id"]]
    got = [(r["doc_id"], r["text"]) for r in near_dup.drop_near_duplicates(df).collect()]
    assert collections.Counter((i, t) for i, t in got if not t) == {(None, None): 1, (None, ""): 1}
    texts = [(i, groups[t.lower().split()[0]]) for i, t in got if t]
    assert collections.Counter(texts) == {(i, t): 1 for t, i in first.items()}


def _line_groups(rows, percent=80, width=line_dedup.WIDTH):
    """{(doc, line): first (doc, line)} by comparing all pairs of lines."""
    low = -(10**30)
    lines = {}
    for r in rows:
        for k, x in enumerate((r[1] or "").split("\n")):
            text = " ".join(w for w in words("".join(c.lower() if "A" <= c <= "Z" else c for c in x)))
            if text:
                lines[(low if r[0] is None else r[0], k)] = {text[i : i + width] for i in range(len(text) - width + 1)} or {text}
    keys = sorted(lines)
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(lines[a] & lines[b])
            if both and 100 * both >= percent * len(lines[a] | lines[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def line_rows(seed=2):
    rng = random.Random(seed)
    pool = [prose(rng, rng.randint(3, 25), 5000) for _ in range(25)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(0, 6)):
            kind, line = rng.random(), rng.choice(pool)
            if kind < 0.3:
                own.append(line)
            elif kind < 0.6:
                w = line.split()
                w[rng.randrange(len(w))] = f"q{rng.randrange(1000)}"
                own.append("  ".join(w).upper() if kind < 0.4 else " ".join(w))
            else:
                own.append(rng.choice(["", " ", prose(rng, 12, 10**6)]))
        rows.append((i, "\n".join(own), "en", "s", 0))
    return rows


def test_fuzzy_lines_as_all_pairs(spark):
    rows = [r for r in edge_rows() if r[0] != 9] + [(r[0] + 100, *r[1:]) for r in line_rows()]
    want = {k: v for k, v in _line_groups(rows).items() if k != v}
    low = -(10**30)
    got = line_dedup.duplicate_lines(clashing(spark.createDataFrame(rows, DOCS)).repartition(5)).collect()
    found = {(low if r["doc_id"] is None else r["doc_id"], r["line"]): (low if r["keep_doc"] is None else r["keep_doc"], r["keep_line"]) for r in got}
    assert found == want


def test_lines_with_one_changed_character_link(spark):
    """The width is a literal here, so that a wider shingle fails."""
    rng = random.Random(17)
    rows = []
    for i in range(30):
        line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(25, 110))).strip()
        at = rng.randrange(len(line))
        rows += [(2 * i, line, "en", "s", 0), (2 * i + 1, line[:at] + "z" + line[at + 1 :], "en", "s", 0)]
    want = {k: v for k, v in _line_groups(rows, width=5).items() if k != v}
    assert len(want) >= 15
    got = line_dedup.duplicate_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r["doc_id"], r["line"]): (r["keep_doc"], r["keep_line"]) for r in got} == want


def test_lines_leave_the_texts(spark):
    rows = line_rows(5)
    df = clashing(spark.createDataFrame(rows, DOCS))
    gone = {k for k, v in _line_groups(rows).items() if k != v}
    out = line_dedup.drop_duplicate_lines(df)
    assert out.columns == df.columns
    want = {}
    for r in rows:
        lines = r[1].split("\n")
        text = "\n".join(x for k, x in enumerate(lines) if (r[0], k) not in gone)
        if words(text) or not any((r[0], k) in gone for k in range(len(lines))):
            want[r[0]] = text
    got = out.collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    report = {r["doc_id"]: r for r in line_dedup.line_report(df).collect()}
    assert all(report[i]["kept"] == (i in want) for i in report)
    assert line_dedup.line_report(df.limit(0)).count() == 0


def test_overlaps_with_substitutions(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice([6, 12, 30, 60]), 10**6)) for i in range(30)] + [(100, None), (101, ""), (102, "two words"), (None, prose(rng, 20, 10**6))]
    rows, leaks = [], {}
    for i in range(120):
        text = prose(rng, rng.randint(20, 200), 10**6).split()
        if i % 3 == 0:
            item, source = rng.choice([x for x in items if x[1] and len(x[1].split()) > 5])
            passage = source.split()
            if len(passage) >= 30:
                passage[len(passage) // 2] = "changed"
                passage = passage[: rng.randint(20, len(passage))]
            at = rng.randint(0, len(text))
            text[at:at] = passage
            leaks[i] = item
        rows.append((i, " ".join(text).title(), "en", "s", 0))
    rows += [(500, None, None, None, 0), (None, "", None, None, 0), (501, "two words", None, None, 0)]
    docs, bench = clashing(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.overlaps(docs, bench).collect()}
    assert {i for i, r in got.items() if not r["kept"]} == set(leaks)
    assert all(leaks[i] in got[i]["item_ids"] for i in leaks)
    assert len(got) == len(rows)
    clean = decontaminate.drop_overlapping(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len(leaks)
    assert all(r["kept"] for r in decontaminate.overlaps(docs, bench.limit(0)).collect())
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0


def _hashed(text):
    return word_hashes(pa.array([text]), blank=NOT_WORD)[0]


def _lawful(equal, n):
    """Whether some stretch of the line-up is an overlap with an item of n tokens, by trying all."""
    least = min(10, -(-8 * n // 10))
    return any(sum(equal[i:j]) >= least and 5 * sum(equal[i:j]) >= 4 * (j - i) for i in range(len(equal)) for j in range(i + least, len(equal) + 1))


def test_every_lawful_overlap_is_found():
    """Items of 4 to 30 tokens with none, one and two substitutions at all places, and more in some, against the law in brute force."""
    more = [(15, 3), (16, 3), (20, 3), (20, 4)]
    for n, k in [(n, k) for n in range(4, 31) for k in (0, 1, 2)] + more:
        item = [f"t{i}" for i in range(n)]
        for way in itertools.combinations(range(n), k):
            text = ["before", *(f"s{i}" if i in way else w for i, w in enumerate(item)), "after"]
            got = decontaminate.spans(_hashed(" ".join(text)), _hashed(" ".join(item)))
            assert bool(got) == _lawful([i not in way for i in range(n)], n), (n, way)
            for first, size, equal in got:
                own = [i not in way for i in range(first - 1, first - 1 + size)]
                assert equal == sum(own) and 5 * equal >= 4 * size and equal >= min(10, -(-8 * n // 10))


def test_parts_of_long_items_are_found():
    rng = random.Random(40)
    for _ in range(300):
        item = [f"t{i}" for i in range(rng.randint(12, 60))]
        a = rng.randrange(len(item) - 9)
        part = item[a : rng.randint(a + 8, len(item))]
        way = set(rng.sample(range(len(part)), rng.randint(0, 3)))
        text = [f"x{i}" for i in range(rng.randint(0, 9))] + [f"s{i}" if i in way else w for i, w in enumerate(part)] + ["y"]
        got = decontaminate.spans(_hashed(" ".join(text)), _hashed(" ".join(item)))
        assert bool(got) == _lawful([i not in way for i in range(len(part))], len(item))


def test_periodic_texts_cost_little():
    import time

    began = time.time()
    for item, text in (("a " * 800, "a " * 20_000), ("a b " * 400, "b a c " * 5000), ("a a a a b " * 100, "a a a a c " * 4000)):
        got = decontaminate.spans(_hashed(text), _hashed(item))
        assert bool(got) == ("b a" not in text), (item[:10], got[:3])
    assert time.time() - began < 30


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rng = random.Random(14)
    items = [(i, prose(rng, 30, 10**6)) for i in range(12)] + [(3, None), (20, "of the")]
    rows = [(i, items[i][1], "en", "s", 0) for i in range(12)] + [(50, prose(rng, 50, 10**6), "en", "s", 0), (0, prose(rng, 50, 10**6), "en", "s", 0), (None, items[1][1], "en", "s", 0), (None, "of the " * 30, "en", "s", 0)]
    rows += [rows[0], (60, "x " * 9000 + items[2][1] + " y" * 9000, "en", "s", 0), (61, items[2][1] + "\n" + items[3][1], "en", "s", 0)]
    docs, bench = clashing(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(items, "item_id long, text string")
    want = [(r[0], sorted(i for i, t in items if t and t in r[1] and len(t) > 10)) for r in rows]
    got = decontaminate.overlaps(docs, bench).collect()
    assert sorted(((r["doc_id"], r["item_ids"]) for r in got), key=repr) == sorted(want, key=repr)
    left = [(r["doc_id"], r["text"]) for r in decontaminate.drop_overlapping(docs, bench).collect()]
    assert sorted(left, key=repr) == sorted(((r[0], r[1]) for r, (_, ids) in zip(rows, want, strict=True) if not ids), key=repr)


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    rng = random.Random(21)
    item = prose(rng, 30, 10**6)
    rows = [(r[0], r[1], "en", "s", 0) for r in family_rows(25, seed=8)]
    rows += [(900, f"{prose(rng, 40)} {item} {prose(rng, 10)}", "en", "s", 0), (901, "too short", "en", "s", 0), (902, None, "en", "s", 0)]
    rows += [(903 + i, f"shared boilerplate line of this site number one\n{prose(rng, 40, 10**6)}", "en", "s", 0) for i in range(3)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r for r in rows if len(words(r[1])) >= 20]
    gone = {k for k, v in _line_groups(left).items() if k != v}
    cut = [(r[0], "\n".join(x for k, x in enumerate(r[1].split("\n")) if (r[0], k) not in gone)) for r in left]
    cut = [r for r in cut if words(r[1])]
    roots = components(cut, 5, 80)
    want = {r[0]: r[1] for r in cut if roots[r[0]] == r[0] and item not in r[1]}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {i: spark.range(1).select(F.sha2(F.lit(t), 256)).first()[0] for i, t in want.items()}


def test_pipeline_takes_odd_tables(spark, tmp_path):
    """Null ids, unlike texts under one id, repeated rows and clashing columns; then empty tables."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    rng = random.Random(22)
    texts = [prose(rng, 50, 10**6) for _ in range(8)]
    item = prose(rng, 30, 10**6)
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, None), (None, None), (7, ""), (8, texts[4] + " more"), (9, texts[4]), (10, f"{texts[5]} {item}"), (None, item), (11, texts[6].upper())]
    docs = clashing(spark.createDataFrame([(*r, None, "s", 0) for r in rows], DOCS))
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    bench = spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/a/benchmark.parquet")
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (8, texts[4] + " more"), (11, texts[6].upper())]
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    digest = lambda t: spark.range(1).select(F.sha2(F.lit(t), 256)).first()[0]
    assert sorted(((r["doc_id"], r["decoded_sha256"]) for r in got), key=repr) == sorted(((i, digest(t)) for i, t in want), key=repr)
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, f"{tmp_path}/a")
        assert held.columns == docs.columns, name
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    bench.limit(0).write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("seed", [33, 34, 35])
def test_a_hot_key_loses_no_link(spark, monkeypatch, seed):
    """One large family in chunks and tiles, copies on both sides of the law, as all pairs give them."""
    from tessel.llm import buckets

    monkeypatch.setattr(buckets, "CHUNK", 7)
    monkeypatch.setattr(buckets, "ENTRIES", 500)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(90):
        other = list(base)
        for k in rng.sample(range(40), rng.choice([1, 2, 3, 4, 5])):
            other[k] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(other), "en", "s", 0))
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    want = components(rows, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, 2).collect()}
    assert got == want
    lines = {k: v for k, v in _line_groups(rows).items() if k != v}
    found = {(r["doc_id"], r["line"]): (r["keep_doc"], r["keep_line"]) for r in line_dedup.duplicate_lines(df).collect()}
    assert found == lines


def test_recall_of_bands():
    """Of pairs at the least similarity at most 2 in 1000 share no band, in lines and in documents."""
    import numpy as np

    from tessel.llm.shingles import MinHash

    rng = np.random.default_rng(5)
    n, shared = 3000, 160
    bands, hasher = MinHash(line_dedup.BANDS, line_dedup.ROWS), MinHash(line_dedup.SAMPLES, 1, seed=9)
    near = MinHash(near_dup.BANDS, near_dup.ROWS)
    missed = [0, 0]
    for _ in range(n):
        both, own = rng.integers(0, 2**64, shared, dtype=np.uint64), rng.integers(0, 2**64, (2, shared // 8), dtype=np.uint64)
        sets = [np.concatenate([both, own[k]]) for k in (0, 1)]  # 160 of 200
        # Lines are sampled by their factors alone.
        lines = [bands.band_keys(line_dedup.banded(((s >> np.uint64(32)).astype(np.uint32)[:, None] * hasher.a).min(axis=0)[None])) for s in sets]
        docs = [near.band_keys(near.samples(s)[None]) for s in sets]
        missed[0] += not (lines[0] == lines[1]).any()
        missed[1] += not (docs[0] == docs[1]).any()
    assert missed[0] <= 0.004 * n and missed[1] <= 0.002 * n


def test_shingles_of_lines_lie_within_them():
    rng = random.Random(41)
    lines = ["a", "ab", "abcd", "abcde", "abcdef", "\U0001f600x", "é" * 40, "ab" * 20000, *(prose(rng, rng.randrange(1, 60), 500) for _ in range(300)), "z"]
    runs = [[x.ljust(line_dedup.WIDTH, "\n")[k : k + line_dedup.WIDTH] for k in range(max(1, len(x) - line_dedup.WIDTH + 1))] for x in lines]
    for kind in (np.uint32, np.uint64):
        grams, sizes = line_dedup._windows(lines, kind, block=64)
        assert sizes.tolist() == [len(x) for x in runs] and len(grams) == sum(sizes)
        names = {}
        assert all(names.setdefault(run, g) == g for run, g in zip(itertools.chain(*runs), grams.tolist(), strict=True))
        assert len(set(names.values())) == len(names)
    hasher = MinHash(line_dedup.SAMPLES, 1, seed=9)
    grams, sizes = line_dedup._windows(lines, np.uint32)
    ends = np.cumsum(sizes)
    want = np.array([[(grams[a:b] * x).min() for x in hasher.a] for a, b in zip(ends - sizes, ends, strict=True)])
    for block in (1, 300, 1 << 15):
        assert (line_dedup.signatures(lines, hasher, block) == want).all()
    sets = line_dedup.shingle_sets(lines)
    assert sets.sizes.tolist() == [len(set(x)) for x in runs]


def test_entries_come_in_the_order_of_their_keys():
    rng = np.random.default_rng(42)
    for n, bands, top in ((1, 1, 2**64 - 1), (500, 28, 2**64 - 1), (500, 28, 2**20), (70000, 3, 2**64 - 1), (70000, 3, 2**20)):
        ids, keys = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(0, top, (n, bands), dtype=np.uint64, endpoint=True)
        want = sorted(zip((keys >> np.uint64(16)).ravel().tolist(), np.repeat(ids, bands).tolist(), strict=True))
        flat, who = buckets._dealing(ids, keys)
        assert (flat[1:] >= flat[:-1]).all() and sorted(zip(flat.tolist(), who.tolist(), strict=True)) == want
    for keys in (np.empty(0, np.uint64), np.array([7], np.uint64), np.full(5, 2**64 - 1, np.uint64), rng.integers(0, 2**64 - 1, 999, dtype=np.uint64), rng.integers(2**40, 2**40 + 50, 999, dtype=np.uint64)):
        ids = rng.integers(-(2**63), 2**63 - 1, len(keys))
        got, who = buckets._ordered(keys, ids)
        assert (got == np.sort(keys)).all()
        assert sorted(zip(got.tolist(), who.tolist(), strict=True)) == sorted(zip(keys.tolist(), ids.tolist(), strict=True))


def test_dealing_costs_less_than_sorting_places_by_keys():
    rng = np.random.default_rng(43)
    ids, keys = rng.integers(-(2**63), 2**63 - 1, 35000), rng.integers(0, 2**64 - 1, (35000, 28), dtype=np.uint64)

    def places() -> None:
        flat, who = (keys >> np.uint64(16)).ravel(), np.repeat(ids, 28)
        order = np.argsort(flat)
        flat[order], who[order]

    def cost(run) -> float:
        spent = []
        for _ in range(7):
            start = time.process_time()
            run()
            spent.append(time.process_time() - start)
        return min(spent)

    assert cost(lambda: list(buckets._dealt(ids, keys, 51, 1000))) < cost(places)
