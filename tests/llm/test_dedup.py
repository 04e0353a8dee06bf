from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termwarden.llm import chunking, exact_dedup, queries, simhash
from termwarden.llm.common import numbered, with_facts, work_folder
from termwarden.llm.components import components
from termwarden.sources.scratch import WorkFolder
from tests.llm.conftest import AWKWARD


def index_of(spark, docs):
    return exact_dedup.DigestIndex(spark, f"{work_folder(docs).path}/index", buckets=3)


def lowered(text):
    return (text or "").encode().lower()


def test_exact_copies(spark, awkward):
    found = exact_dedup.deduplicated(awkward, index_of(spark, awkward)).collect()
    groups = defaultdict(list)
    for doc_id, text in AWKWARD:
        groups[hashlib.sha256(lowered(text)).hexdigest()].append(doc_id)
    assert len(found) == len(AWKWARD)
    for r in found:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max(ids, key=lambda i: -1 if i is None else i)
    kept = [r.text_sha256 for r in found if r.kept]
    assert sorted(kept) == sorted(groups)


def test_index_outlives_a_batch(spark, docs_of):
    first = docs_of([(1, "one"), (2, "two"), (3, "TWO")])
    index = index_of(spark, first)
    exact_dedup.deduplicated(first, index).count()
    again = exact_dedup.DigestIndex(spark, index.path, buckets=3)
    second = docs_of([(9, "two"), (10, "three"), (3, "two")])
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicated(second, again).collect()}
    assert found == {9: (3, False), 10: (10, True), 3: (3, True)}
    assert sorted(r.keep_id for r in again.read().collect()) == [1, 3, 10]
    assert exact_dedup.deduplicated(first.limit(0), again).count() == 0


@pytest.mark.parametrize(("before", "after"), [(8, 3), (3, 8)])
def test_an_index_keeps_its_buckets(spark, docs_of, before, after):
    """Another session, to which the table is unknown, opens all of the index."""
    texts = [f"text {i}" for i in range(40)]
    docs = docs_of(list(enumerate(texts)))
    path = f"{work_folder(docs).path}/index"
    index = exact_dedup.DigestIndex(spark, path, before)
    assert exact_dedup.deduplicated(docs, index).where("kept").count() == 40
    spark.sql(f"DROP TABLE {index.table}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.raises(ValueError, match=f"has {before} buckets"):
            exact_dedup.DigestIndex(spark, path, after)
        again = exact_dedup.DigestIndex(spark, path)
        more = docs_of([(100 + i, t) for i, t in enumerate(texts)])
        assert exact_dedup.deduplicated(more, again).where("kept").count() == 0
        assert again.read().count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_at_once_add_a_digest_once(spark, docs_of):
    path = f"{work_folder(docs_of([])).path}/index"
    index = exact_dedup.DigestIndex(spark, path, 4)

    def batch(start):
        docs = docs_of([(start + i, f"text {i}") for i in range(30)])
        return exact_dedup.deduplicated(docs, index).collect()

    with ThreadPoolExecutor(3) as pool:
        found = [row for rows in pool.map(batch, (0, 100, 200)) for row in rows]
    assert len(found) == 90
    assert index.read().count() == 30 == sum(r.kept for r in found)
    assert {r.text_sha256: r.keep_id for r in found if r.kept} == {r.text_sha256: r.keep_id for r in found}


def test_a_lock_of_another_driver_is_waited_for(spark, docs_of, monkeypatch):
    path = f"{work_folder(docs_of([])).path}/index"
    index = exact_dedup.DigestIndex(spark, path, 4)
    monkeypatch.setattr(exact_dedup, "PATIENCE", 0.5)
    (Path(index.path) / "lock").touch()
    with pytest.raises(TimeoutError, match="lock"), index.locked():
        pass
    (Path(index.path) / "lock").unlink()
    with index.locked():
        assert (Path(index.path) / "lock").exists()
    assert not (Path(index.path) / "lock").exists()


def test_the_index_is_joined_without_a_shuffle_of_it(spark, docs_of):
    docs = docs_of([(i, f"t{i}") for i in range(50)])
    index = index_of(spark, docs)
    exact_dedup.deduplicated(docs, index).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = docs.select(F.unhex(F.sha2("text", 256)).alias("digest")).distinct()
        joined = index.unknown(new)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange") == 2  # of the new rows alone: distinct, then dealt


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(i, i + 1) for i in range(40)],
        [(100, i) for i in range(30)] + [(i, i) for i in range(3)],
        [(7, 3), (3, 7), (9, 7), (20, 21)],
    ],
)
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in components(frame, WorkFolder(spark)).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: r for n, r in root.items() if any(a != b and n in (a, b) for a, b in edges)}


def test_triples_cover_every_four_positions():
    kept = set(simhash.triples())
    assert len(kept) == 20
    assert all(any(set(t) <= set(four) for t in kept) for four in combinations(range(8), 4))


def plain_fingerprint(text, words=4):
    parts = lowered(text).split()
    size = min(words, len(parts))
    shingles = [b" ".join(parts[i : i + size]) for i in range(len(parts) - size + 1)] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def check_links(rows, found, most_bits):
    marks = [(doc_id, plain_fingerprint(text)) for doc_id, text in rows]
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(marks)), 2):
        if (marks[i][1] ^ marks[j][1]).bit_count() <= most_bits:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    smallest = {}
    for i, (doc_id, _) in enumerate(marks):
        if doc_id is not None:
            smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    expected = sorted((d if d is not None else -1, f"{m:016x}", smallest.get(find(i))) for i, (d, m) in enumerate(marks))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint.hex(), r.component_id) for r in found)
    assert got == expected


def test_simhash_links_against_brute_force(spark, docs_of):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        base = [random.choice(vocabulary) for _ in range(150)]
        for _ in range(4):
            words = list(base)
            words[random.randrange(150)] = "changed"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD) ] + [(None, "alone")]
    docs = docs_of(rows).select("doc_id", "text")
    found = simhash.near_duplicates(docs, work_folder(docs), words=4, most_bits=4).collect()
    check_links(rows, found, 4)


def plain_components(marks):
    values = np.array(marks, np.uint64)
    label = np.arange(len(values))
    while True:
        new = np.array([label[np.bitwise_count(v ^ values) <= 4].min() for v in values])
        if (new == label).all():
            return {i: int(label[i]) for i, v in enumerate(values) if (np.bitwise_count(v ^ values) <= 4).sum() > 1}
        label = new


def found_components(spark, marks):
    rows = [(i, m.to_bytes(8, "big")) for i, m in enumerate(marks)]
    work = WorkFolder(spark)
    stored = work.write("marks", spark.createDataFrame(rows, "node long, fingerprint binary"))
    return {r.node: r.root for r in simhash.linked_components(stored, work).collect()}


@pytest.mark.parametrize("block", [16, 512])
def test_crowded_lists_lose_no_link(spark, monkeypatch, block):
    """A thousand fingerprints around one, in lists that are refined and cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    marks = {0}
    while len(marks) < 1200:
        flips = rng.choice(64, size=rng.integers(1, 7), replace=False)
        marks.add(int(sum(1 << int(b) for b in flips)))
    assert found_components(spark, sorted(marks)) == plain_components(sorted(marks))


def test_clusters_that_share_bytes_are_compared_across_blocks(spark, monkeypatch):
    """All share five bytes, but only some are near each other: no task gets a whole list."""
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = np.random.default_rng(4)
    marks = sorted({0x0102030405 << 24 | int(x) for x in rng.integers(0, 1 << 24, 700)})
    # Thinly spread over batches, lists are counted all the same.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found_components(spark, marks) == plain_components(marks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_looser_limits_are_refused(spark, docs_of):
    docs = docs_of([(1, "a")])
    with pytest.raises(ValueError, match="4 differing bits"):
        simhash.near_duplicates(docs, work_folder(docs), most_bits=5)


def plain_cuts(data):
    """The rolling hash byte by byte."""
    ends, last, rolled = [], 0, 0
    for at, byte in enumerate(data):
        rolled = (rolled * 2 + int(chunking.GEAR[byte])) & 0xFFFFFFFF
        size = at + 1 - last
        hit = rolled >> (32 - chunking.MASK_BITS) == 0
        if size >= chunking.MOST or (hit and size >= chunking.LEAST) or at + 1 == len(data):
            last = at + 1
            ends.append(last)
    return ends


def test_chunks_are_those_of_a_byte_by_byte_roll(monkeypatch):
    rng = np.random.default_rng(1)
    for size in (0, 1, 15, 16, 17, 300, 5000):
        data = rng.integers(97, 123, size, dtype=np.uint8).tobytes()
        assert chunking.cut_points(data) == plain_cuts(data)
    data = rng.integers(97, 123, 5000, dtype=np.uint8).tobytes()
    monkeypatch.setattr(chunking, "SPAN", 100)
    assert chunking.cut_points(data) == plain_cuts(data)
    assert chunking.cut_points(b"a" * 1000) == plain_cuts(b"a" * 1000)


def test_repeated_passages(docs_of):
    random.seed(2)
    words = [f"v{i}x" for i in range(3000)]
    some = lambda n: " ".join(random.choice(words) for _ in range(n))
    passage = some(60)
    rows = [(i, some(100)) for i in range(20)]
    rows += [(100, some(37) + " " + passage + " " + some(50)), (101, some(64) + " " + passage)]
    rows += [(200, None), (201, ""), (202, "short")]
    docs = docs_of(rows).withColumn("_row", F.monotonically_increasing_id())
    found = chunking.repeated_passages(docs, work_folder(docs)).collect()
    assert sorted((r.doc_id, r.kept) for r in found) == [(100, True), (101, False)]
    for r in found:
        text = dict(rows)[r.doc_id].encode()
        at = text.index(passage.encode())
        assert text[r.start : r.end] in passage.encode() or r.start < at + len(passage) and r.end > at
    cut = {r.doc_id: r.text for r in chunking.without_repeats(docs, work_folder(docs)).collect()}
    assert all(cut[d] == t for d, t in rows if d != 101)
    assert len(cut[101]) < len(dict(rows)[101])


def test_first_occurrences_beside_repeats_stay(docs_of):
    """The second text adjoins a repeat of the first with what the third repeats."""
    random.seed(4)
    some = lambda n: " ".join(f"v{random.randrange(10**6)}x" for _ in range(n))
    long = some(240).split()
    first, whole, last = " ".join(long[:140]), " ".join(long), " ".join(long[100:])
    rows = [(1, some(60) + " " + first), (2, some(60) + " " + whole), (3, some(60) + " " + last)]
    docs = docs_of(rows).coalesce(1).withColumn("_row", F.col("doc_id"))
    found = chunking.repeated_passages(docs, work_folder(docs)).collect()
    assert sorted((r.doc_id, r.kept) for r in found) == [(1, True), (2, False), (2, True), (3, False)]
    kept = "\n".join(r.text for r in chunking.without_repeats(docs, work_folder(docs)).collect())
    held = [w for w in long if w in kept]
    assert len(held) >= len(long) - 2 and len(kept) < sum(len(t) for _, t in rows) - 800


def test_repeats_within_a_document_are_reported(spark, tmp_path, docs_of):
    random.seed(5)
    some = lambda n: " ".join(f"v{random.randrange(10**6)}x" for _ in range(n))
    passage = some(80)
    docs_of([(1, " ".join([some(50), passage, some(50), passage, some(9)])), (2, some(200))]).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    found = queries.op5_chunking(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.kept) for r in found) == [(1, False), (1, True)]


def plain_passages(texts):
    """`(row, start, end, chunks, repeats, first row, kept)` from lists of chunks."""
    chunks, seen = [], defaultdict(list)
    for row, text in enumerate(texts):
        data, last = (text or "").encode().translate(chunking.BLANKS), 0
        chunks.append([])
        for end in plain_cuts(data) if data else []:
            seen[data[last:end]].append((row, len(chunks[row])))
            chunks[row].append((last, end, data[last:end]))
            last = end
    out = []
    for row, parts in enumerate(chunks):
        runs = [[]]
        for at, (_, _, digest) in enumerate(parts):
            if len(seen[digest]) > 1:
                runs[-1].append(at)
            elif runs[-1]:
                runs.append([])
        for run in filter(None, runs):
            if parts[run[-1]][1] - parts[run[0]][0] < chunking.PASSAGE:
                continue
            first = [seen[parts[at][2]][0] == (row, at) for at in run]
            start = 0
            for at in range(1, len(run) + 1):
                if at == len(run) or first[at] != first[start]:
                    span = run[start:at]
                    firsts = min(seen[parts[x][2]][0][0] for x in span)
                    out.append((row, parts[span[0]][0], parts[span[-1]][1], len(span), 0 if first[start] else len(span), firsts, first[start]))
                    start = at
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_passages_against_plain_chunks(spark, docs_of, seed):
    """Shared passages among random texts: the same spans, and nearly all that were planted."""
    rng = random.Random(seed)
    some = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    passages = [some(60) for _ in range(12)]
    texts, planted = [], 0
    for i in range(90):
        parts = [some(rng.randrange(1, 80))]
        for passage in rng.sample(passages, rng.randrange(3)):
            parts += [passage, some(rng.randrange(1, 40))]
        texts.append(" ".join(parts))
    texts += [None, "", texts[3], texts[4].replace(" ", "\n")]
    docs = docs_of(list(enumerate(texts))).coalesce(1).withColumn("_row", F.col("doc_id"))
    found = chunking.repeated_passages(docs, work_folder(docs)).collect()
    names = ("_row", "start", "end", "chunks", "repeats", "first_row", "kept")
    assert sorted(tuple(r[n] for n in names) for r in found) == plain_passages(texts)
    spans = defaultdict(list)
    for r in found:
        spans[r._row].append((r.start, r.end))
    caught = 0
    for row, text in enumerate(texts):
        for passage in passages:
            if text and passage in text and sum(passage in (t or "") for t in texts) > 1:
                at, planted = text.index(passage), planted + 1
                caught += any(a < at + len(passage) and b > at for a, b in spans[row])
    assert planted > 50 and caught >= 0.9 * planted


def test_repeats_are_cut_whatever_ids_and_columns_there_are(spark, docs_of):
    rng = random.Random(3)
    some = lambda n: " ".join(f"é{rng.randrange(10**5)}x" for _ in range(n))
    passage = some(90)
    rows = [(None, some(30) + " " + passage), ("b", passage + " " + some(30)), ("b", None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    docs = docs.withColumns({n: F.lit(n) for n in ("_spans", "_row", "_doc", "_text", "end", "kept")})
    cut = chunking.without_repeats(docs, work_folder(docs))
    assert cut.columns == docs.columns
    found = [tuple(r) for r in cut.collect()]
    assert [r[2:] for r in found] == [("_spans", "_row", "_doc", "_text", "end", "kept")] * 4
    assert found[0][:2] == rows[0] and found[2][:2] == rows[2] and found[3][:2] == rows[3]
    assert rows[1][1].endswith(found[1][1][-60:]) and len(found[1][1]) < len(rows[1][1]) - 300
    assert chunking.without_repeats(docs.limit(0), work_folder(docs)).count() == 0


def test_facts_are_looked_up_without_a_shuffle_of_rows(spark):
    rows = spark.range(1000, numPartitions=7).selectExpr("id", "concat('t', id) AS text")
    work = work_folder(rows)
    stored = numbered(rows, work)
    even = stored.where("_doc.id % 2 = 0").select("_row", F.col("_doc.id").alias("copy"))
    found = with_facts(stored, even, work, "even")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.text, r.copy) for r in found.collect()) == [(i, f"t{i}", i) for i in range(0, 1000, 2)]
    every = with_facts(stored, even, work, "every", every=True).collect()
    assert {r.id: r.copy for r in every} == {i: None if i % 2 else i for i in range(1000)}
    nothing = with_facts(stored, even.limit(0), work, "nothing")
    assert nothing.count() == 0 and nothing.columns == ["id", "text", "copy"]
    with pytest.raises(ValueError, match="_doc"):
        with_facts(stored, even.withColumnRenamed("copy", "_doc"), work, "clash")
    files = work_folder(rows)
    gone = with_facts(stored, even, files, "gone")
    files.delete()
    with pytest.raises(Exception, match="no such folder"):
        gone.count()


def test_chunks_of_awkward_rows(awkward):
    docs = awkward.withColumn("_row", F.monotonically_increasing_id())
    chunks = chunking.chunks(docs).groupBy("_row").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()
    sizes = sorted(len((t or "").encode()) for _, t in AWKWARD if t)
    assert sorted(r.n for r in chunks) == sizes
    assert chunking.repeated_passages(docs.limit(0), work_folder(docs)).count() == 0
