"""Embeddings compared in blocks of tiles: the same pairs and classes as by brute force, with few copies of each row shuffled."""

import numpy as np
import pyarrow as pa

from warcloom.llm import embedding_dedup as ed


def _vectors(n: int, d: int) -> np.ndarray:
    rnd = np.random.default_rng(11)
    a = rnd.normal(size=(n, d))
    a[: n // 4] = a[n // 4 : n // 4 * 2] + rnd.normal(size=(n // 4, d)) * 0.1
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _classes(near: np.ndarray) -> list[int]:
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None], len(near)).min(1))
        if (low == label).all():
            return label.tolist()
        label = low


def test_blocks_of_two_sides(monkeypatch):
    """A task's part: at a threshold that many pairs reach and at one that few do, with edges held a few at a time."""
    monkeypatch.setattr(ed, "EDGES", 50)
    monkeypatch.setattr(ed, "ROWS", 32)
    a = _vectors(300, 40)
    a = a[np.argsort(a[:, 0])]
    product = a @ a.T

    def side(at, prefix):
        rows = np.random.default_rng(1).permutation(np.arange(*at))
        return pa.table({f"{prefix}tile": pa.array(rows // 16), f"{prefix}id": pa.array(rows), f"{prefix}v": pa.array([a[k].tobytes() for k in rows], pa.binary())})

    for t in (0.0, 0.3, 0.95):
        for left, right in (((0, 150), (150, 300)), ((0, 300), (0, 300))):
            pairs = {(i, j) for i, j in zip(*np.nonzero(product >= t)) if i < j and (left == right or (i < 150 <= j))}
            key = (pa.scalar(0), pa.scalar(int(left != right)))
            got = ed._block(t, True)(key, side(left, ""), side(right, "r"))
            assert {(r["id_a"], r["id_b"]) for r in got.to_pylist()} == pairs and got.num_rows == len(pairs)
            assert all(abs(r["cosine"] - product[r["id_a"], r["id_b"]]) < 1e-6 for r in got.to_pylist())
            near = np.zeros((300, 300), bool)
            for i, j in pairs:
                near[i, j] = near[j, i] = True
            got = {r["id"]: (r["root"], r["links"]) for r in ed._block(t, False)(key, side(left, ""), side(right, "r")).to_pylist()}
            roots = _classes(near)
            assert got == {k: (roots[k], int(near[k].sum())) for k in range(300) if near[k].any()}


def test_classes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "AT_ONCE", 100)
    a = _vectors(400, 24)
    near = (a @ a.T >= 0.4) & ~np.eye(400, dtype=bool)
    df = spark.createDataFrame([(k, [float(z) for z in x]) for k, x in enumerate(a)], "vec_id long, embedding array<double>")
    got = ed.embedding_classes(df, 0.4, tile=8, block=64).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == list(zip(range(400), _classes(near), near.sum(1).tolist()))
