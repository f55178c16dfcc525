"""The language model's shards: what blocks know is not searched, a shard is a task, a sample moves no other data."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxelgrain.llm import lm
from voxelgrain.llm.common import crc_split
from voxelgrain.storage import stage


def blocks(r, n: int = 6) -> list[list[np.ndarray]]:
    """[words, asked, fan1, second, fan2, third, count] of random chunks, a part of them not learned from."""
    out, every = [], np.unique(r.integers(16, 2**64, 30, dtype=np.uint64))
    for _ in range(n):
        words = r.permutation(every)[:20]
        place = np.argsort(words)
        grams = np.unique(r.integers(0, 20, (300, 3)), axis=0)
        pairs, in_pair = np.unique(grams[:, :2], axis=0, return_inverse=True)
        asked, in_asked = np.unique(pairs[:, 0], return_inverse=True)
        count = r.integers(0, 4, len(grams)) * (r.random(len(grams)) < 0.6)
        out.append([words, place[asked], np.bincount(in_asked), place[pairs[:, 1]], np.bincount(in_pair.ravel()), place[grams[:, 2]], count])
    return out


def test_known_nodes_are_those_a_search_finds():
    made = blocks(np.random.default_rng(5))
    counts = [b[6] for b in made]
    trie, known = lm.build(made)
    total = 0
    for b, n, (place, pair, tri) in zip(made, counts, known, strict=True):
        place = place.astype(np.int64)
        none = [np.full(len(x), -1, np.int32) for x in (pair, tri)]
        quick, slow = trie.answer(place, *b[1:6], pair, tri, trie.steps()), trie.answer(place, *b[1:6], *none, trie.steps())
        assert all((x == y).all() for x, y in zip(quick, slow, strict=True))
        under = trie.nodes(trie.to2, place[b[1]])
        assert (slow[0] == trie.count_of_word(under)).all() and (slow[1] == under[1] - under[0]).all()
        at = trie.successor(trie.second, under, b[2], place[b[3]])
        assert (slow[2] == trie.count_of_pair(at)).all() and (at[pair >= 0] == pair[pair >= 0]).all()
        assert ((tri >= 0) == (n > 0)).all()
        total += (pair >= 0).sum()
    assert total


def test_select_finds_every_bit():
    r = np.random.default_rng(1)
    for v in (np.arange(300), np.repeat(7, 300), np.cumsum(r.integers(0, 200, 5000) * (r.random(5000) < 0.02)), np.sort(r.integers(0, 2**40, 999))):
        e = lm.EliasFano(*lm.EliasFano.parts(v.astype(np.uint64)))
        assert (e.get(np.arange(len(v))) == v.astype(np.uint64)).all() and (e.steps() == np.diff(v)).all()


def written(spark) -> int:
    """Bytes shuffled by all stages so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_sample_of_chunks_moves_their_numbers_alone(spark):
    r = np.random.default_rng(2)
    data = [lm.pack(r.integers(16, 2**64, 9000, dtype=np.uint64), np.arange(9000), np.arange(9000)) for _ in range(24)]
    chunks = stage(spark.createDataFrame([(k, d) for k, d in enumerate(data)], "chunk long, data binary").repartition(6), "chunks")
    before = written(spark)
    assert len(lm._common(chunks)) == 9000 * lm.SAMPLE_CHUNKS
    assert written(spark) - before < len(data[0])


def test_a_shard_is_a_task(spark, monkeypatch):
    def own(hot, common):
        def work(t):
            from pyspark import TaskContext

            row = {"chunk": [-1], "shard": [t["shard"][0].as_py()], "data": [b""], "texts": [TaskContext.get().partitionId()], "tokens": [0], "types": [0]}
            return pa.table({k: pa.array(v, {"shard": pa.int32(), "data": pa.binary()}.get(k, pa.int64())) for k, v in row.items()})

        return work

    made = []
    monkeypatch.setattr(lm, "_answer", own)
    monkeypatch.setattr(lm, "stage", lambda df, name: made.append(stage(df, name)) or made[-1])
    texts = spark.createDataFrame([(k, " ".join(f"w{k * j % 97}" for j in range(200))) for k in range(40)], "doc_id long, text string")
    lm.score(texts, crc_split("doc_id", 5) != 1, shard_tokens=500)
    rows = made[-1].select("shard", F.col("texts").alias("task")).collect()
    assert len(rows) > 8 and len({x.task for x in rows}) == len(rows)
