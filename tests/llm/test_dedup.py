"""Near and exact deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citeloom.llm import components, exact, simhash

SCHEMA = "doc_id long, text string, row string, finger string, kept string, at string, level string, name string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


AWKWARD = [
    (1, "one two three four five"),
    (2, "ONE two three four five"),
    (3, ""),
    (4, None),
    (5, " \t\n "),
    (6, "word"),
    (7, "word"),
    (7, "word"),
    (None, "word"),
    (None, "only here"),
    (8, "a  b\tc"),
    (9, "a b c"),
    (10, "long " * 30000),
    (11, "long " * 29999 + "long "),
    (12, "long " * 29999 + "tail"),
]


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, bits=4):
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
    label = np.arange(len(values))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_near_groups_match_brute_force(spark):
    rows = AWKWARD[:10] + [(20 + i, "lorem ipsum dolor sit amet " * 30 + f"end{i}") for i in range(12)]
    got = simhash.near_groups(frame(spark, rows)).collect()
    values = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    label = slow_components(values)
    expected = []
    for (key, _), value, own in zip(rows, values, label, strict=True):
        keys = [k for (k, _), o in zip(rows, label, strict=True) if o == own and k is not None]
        expected.append((key, f"{int(value):016x}", min(keys, default=None), int((label == own).sum())))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)


def test_near_groups_of_nothing(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0


def test_covering_finds_every_close_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = {int(v) for v in base}
    for v in base:
        for n in range(1, 7):
            flip = sum(1 << int(b) for b in rng.choice(64, n, replace=False))
            values.add(int(v) ^ flip)
    values = np.array(sorted(values), np.uint64)
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "finger long")
    for cell in (simhash.CELL, 3):  # small cells cut every anchor
        edges = simhash.links(table, cell=cell)
        roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
        label = slow_components(values)
        groups = {}
        for v, own in zip(values.view(np.int64).tolist(), label.tolist(), strict=True):
            groups.setdefault(own, set()).add(roots.get(v, v))
        assert all(len(g) == 1 for g in groups.values())
        assert len(set.union(*groups.values())) == len(groups)


def test_anchor_code():
    code = simhash.anchors()
    assert len(set(code.tolist())) == 8192
    least = min(int(np.bitwise_count(code[i + 1 :] ^ code[i]).min()) for i in range(0, 200))
    assert least == 24


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def slow_groups(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (key, _), text in zip(rows, norm, strict=True):
        keys = [k for (k, _), n in zip(rows, norm, strict=True) if n == text]
        keep = min((k for k in keys if k is not None), default=None)
        out.append((key, keep, len(keys), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("place", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
@pytest.mark.parametrize("block", [exact.BLOCK, 7000])
def test_exact_groups(spark, place, block):
    got = exact.exact_groups(frame(spark, AWKWARD), block=block, place=place).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    plain = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]
    assert sorted(plain, key=order) == sorted(slow_groups(AWKWARD), key=order)
    kept = {}
    for r in got:
        kept.setdefault(r.text_sha256, []).append((r.kept, r.doc_id == r.keep_id))
    assert all(sum(k for k, _ in v) == 1 for v in kept.values())
    assert all(own or not k for v in kept.values() for k, own in v if any(o for _, o in v))


def test_exact_groups_of_nothing(spark):
    assert exact.exact_groups(frame(spark, [])).count() == 0
