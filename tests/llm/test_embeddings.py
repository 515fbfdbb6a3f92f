import numpy as np
import pytest

from ranklens.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>"


def _brute(rows, threshold=0.95):
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=np.float32).astype(np.float64) if ok else None
        units.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    n = len(rows)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def _rows(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    out, i = [], 0
    while len(out) < n:
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 6)):
            v = base + rng.normal(size=dim) * spread * rng.random() * np.linalg.norm(base) / dim**0.5
            out += [(i, v.astype(np.float32).tolist())] * int(rng.choice([1, 1, 1, 2]))
            i += 1
    return out


@pytest.mark.parametrize("tile,cell_rows", [(2048, 2048), (16, 20)])
def test_brute_force(spark, tile, cell_rows):
    rows = _rows(1, 300, 24, 0.6) + _rows(2, 40, 5, 0.5)
    rows += [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [1.0, None] + [0.0] * 22), (9004, [float("nan")] * 24), (9005, [float("inf")] + [0.0] * 23), (None, rows[0][1]), (9006, [1e-38] * 24), (9007, [3e38] * 24)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS copies", "3 AS first")
    got = sorted((tuple(r) for r in E.near_duplicates(df, tile=tile, cell_rows=cell_rows).collect()), key=str)
    assert got == _brute(rows)


@pytest.mark.parametrize("dim", [3, 64, 1500])
def test_bound_holds_and_tiles_agree(dim):
    rng = np.random.default_rng(4)
    u = rng.normal(size=(400, dim))
    u[200:] = u[:200] + rng.normal(size=(200, dim)) * rng.uniform(0.1, 0.5, (200, 1))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    code, scale, error = E.quantise(u)
    product = (code.astype(int) @ code.astype(int).T) * scale[:, None] * scale[None]
    assert code.dtype == np.int8 and np.abs(code.astype(int)).max() <= 127
    e = error.astype(float)
    assert (np.abs(product - u @ u.T) <= e[:, None] * (1 + e[None]) + e[None] + 1e-9).all()
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.95))}
    for rows in (np.arange(400), rng.permutation(400)[:150]):
        own = (code[rows], scale[rows], error[rows])
        sure, undecided = E.settle(*own, *own, 0.95)
        checked = E.exact(u[rows], u[rows], *undecided, 0.95)
        got = [(rows[i], rows[j]) for i, j in (*zip(*sure), *zip(*checked))]
        assert len(got) == len(set(got)) and set(got) == {p for p in want if p[0] in rows and p[1] in rows}


def test_the_same_pairs_are_undecided_in_any_tile():
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    u = base + rng.normal(size=(300, 64)) * 0.23
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    own = E.quantise(u)
    sure, undecided = E.settle(*own, *own, 0.95)
    assert len(undecided[0]) > 100 and len(sure[0]) > 100
    part = np.unique(np.concatenate(undecided))[::2]
    less = tuple(x[part] for x in own)
    again = E.settle(*less, *less, 0.95)[1]
    inside = {(i, j) for i, j in zip(*undecided) if i in part and j in part}
    assert {(part[i], part[j]) for i, j in zip(*again)} == inside


def test_tiles_get_codes_only(spark):
    rows = _rows(3, 60, 32, 0.5)
    tiles = {}
    keep = E._compare
    E._compare = lambda threshold, full: tiles.setdefault(full, keep(threshold, full))
    try:
        E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).count()
    finally:
        E._compare = keep
    assert set(tiles) == {False, True}
    cells = spark.createDataFrame([(1, 1, b"x", 0.5, 0.1, 32, 0, [])], "node long, copies long, code binary, scale double, error float, dim int, home int, visits array<int>")
    assert "embedding" not in E._tiled(cells, 16).columns


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in E.near_duplicates(spark.createDataFrame([(4, None)], SCHEMA)).collect()] == [(4, 0, 4, True)]
