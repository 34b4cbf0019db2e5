import random

from sluicework.llm import packing
from sluicework.llm.packing import pack, plan, token_sizes

SCHEMA = "doc_id long, tokens long, container string"


def packed(spark, rows, capacity):
    got = pack(spark.createDataFrame(rows, SCHEMA), "doc_id", "tokens", capacity).collect()
    used: dict = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.length
    return got, used


def test_whole_and_tight(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([7, 7, 7, rng.randint(1, 60), rng.randint(1, 300)]), "x") for i in range(800)]
    got, used = packed(spark, rows, 100)
    size = {i: n for i, n, _ in rows}
    parts: dict = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.piece_no, r.start, r.length))
    for i, n in size.items():
        own = sorted(parts[i])
        assert sum(x for *_, x in own) == n and [s for _, s, _ in own] == [100 * k for k in range(len(own))]
        assert len(own) == -(-n // 100)  # cut only where longer than a container
    assert max(used.values()) <= 100
    assert len(used) <= 1.02 * -(-sum(size.values()) // 100) + 1
    assert {(r.doc_id, r.piece_no, r.container) for r in got} == {(r.doc_id, r.piece_no, r.container) for r in packed(spark, rows, 100)[0]}


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(30):
        capacity = rng.randint(5, 40)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
        counts: dict = {}
        for s in sizes:
            counts[s] = counts.get(s, 0) + 1
        load: dict = {}
        placed: dict = {}
        for size, first, n, container in plan(counts, capacity):
            for k in range(n):
                load[container + k] = load.get(container + k, 0) + size
                placed.setdefault(size, set()).add(first + k)
        assert max(load.values()) <= capacity and all(placed[s] == set(range(n)) for s, n in counts.items())
        bins: list = []
        for s in sorted(sizes, reverse=True):
            fit = [b for b in bins if b + s <= capacity]
            if fit:
                bins.remove(max(fit))
                bins.append(max(fit) + s)
            else:
                bins.append(s)
        assert len(load) <= len(bins)


def test_edges(spark):
    assert packed(spark, [], 10)[0] == []
    got, _ = packed(spark, [(1, None, None), (2, 0, ""), (3, -4, "y"), (4, 10, "z"), (4, 10, "z"), (None, 3, None)], 10)
    assert sorted((str(r.doc_id), r.length) for r in got) == [("4", 10), ("4", 10), ("None", 3)]


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "ab cd"), (2, None), (3, ""), (4, "<|endoftext|>" + "词" * 5000)], "doc_id long, text string")
    n = {r.doc_id: r.tokens for r in token_sizes(df, "doc_id", "text").collect()}
    assert n[2] == n[3] == 0 and n[1] == 2 and n[4] > 5000


def test_one_size_and_one_key_fill_the_table(spark):
    """A hot size is spread over tasks and buckets, a hot key too; a plan too long for a broadcast gives the same."""
    rows = [(7, 30, "x")] * 3000 + [(i, 30 + i % 40, "x") for i in range(2000)]
    got, used = packed(spark, rows, 100)
    assert len(got) == 5000 and max(used.values()) <= 100
    counts = {s: sum(n == s for _, n, _ in rows) for s in {n for _, n, _ in rows}}
    assert len(used) == max(c + n for _, _, n, c in plan(counts, 100))
    before = packing.BROADCAST_ROWS, packing.BUCKET_PIECES
    try:
        packing.BROADCAST_ROWS, packing.BUCKET_PIECES = 0, 64
        again, load = packed(spark, rows, 100)
        assert sorted(used.values()) == sorted(load.values()) and len(again) == 5000
    finally:
        packing.BROADCAST_ROWS, packing.BUCKET_PIECES = before


def test_buckets_cover_the_plan():
    rng = random.Random(9)
    counts = {s: rng.randint(1, 500) for s in range(1, 65)}
    rows = plan(counts, 64)
    widths, cut = packing.rank_buckets(rows, counts)
    assert len(cut["length"]) <= 2 * len(rows) + len(counts)
    where = {(s, r): c + r - f for s, f, n, c in rows for r in range(f, f + n)}
    for s, n in counts.items():
        for r in range(n):
            hits = [c + r - f for z, b, f, k, c in zip(*cut.values()) if z == s and b == r // widths[s] and f <= r < f + k] if n < 40 else None
            assert hits is None or hits == [where[s, r]]


def test_report(spark):
    rows = [(i, i % 130, "x") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.packing_report(df, pack(df, "doc_id", "tokens", 100), "doc_id", "tokens", 100).first()
    assert tuple(got) == (sum(n > 0 for _, n, _ in rows), 0, 0, 0, True)


def test_sizes_are_those_of_the_vocabulary(spark):
    """Another library with the same vocabulary counts the same, long runs of letters included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    other.encode_special_tokens = True
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null")
    df = df.unionByName(spark.createDataFrame([(-1, "招聘岗位" * 20_000), (-2, "a" * 3000 + "\ud7ff😀"), (-3, " \n\t ")], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r.tokens for r in token_sizes(df, "doc_id", "text").collect()}
    assert got == {i: len(other.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
