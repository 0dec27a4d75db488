"""Secret ownership, the Merkle manifest and whitening against plain versions, their SQL, planted cases and awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import queries as Q
from tallyloom.llm.op11_secrets import candidates, secrets
from tallyloom.llm.op12_merkle import verified
from tallyloom.llm.op13_whitening import edges, whiten

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("row", "base", "spans", "hash", "live", "key", "idx", "m", "n", "leaf", "way", "bin", "rank", "total", "root", "owner", "x", "dim", "component")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_secret_ownership", "op12_merkle_manifest"])
def test_same_rows_as_sql(name: str, spark: SparkSession) -> None:
    assert not oracle.differences(Q.QUERIES[name](spark, SF), oracle.connect(SF), Q.ORACLE_SQL[name])


def awkward(spark: SparkSession) -> list[tuple]:
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(4000)}" for _ in range(60_000))
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "en", "b", len(long)), (5, "One Two", "en", "b", 7), (6, "ONE two", None, "b", 7), (7, "É😀 ß x" * 9, "de", None, None), (8, "a" * 200_000, "en", "c", 200_000), (9, "Same row", "en", "c", 1), (9, "Same row", "en", "c", 1), (9, "other row", "en", "c", 1), (None, "no id", "en", "c", 1), (None, "no id", "en", "a", 1), (-5, "Minus", "en", "c", 2), (1 << 62, "far", "en", "c", 2), (-(1 << 63), "First", "en", "c", 2)]


def with_clashes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# --- 11

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ENDS = "+/_.=-"


def plain_secrets(rows: list[tuple]) -> dict[int, tuple]:
    """By place of the row: counts, base and all spans as text, live and copied."""

    def looks_live(v: str) -> bool:
        h = -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values()) if v else 0
        return len(v) >= 12 and bool(re.search("[0-9]", v)) and bool(re.search("[A-Za-z]", v)) and not re.search("example|sample|dummy|changeme|placeholder|your|xxxx", v.lower()) and h >= 2.5

    base, bare = defaultdict(list), defaultdict(set)
    for i, (_, text, lang, source, _) in enumerate(rows):
        text = text or ""
        base[i] += [(m.start(), 1, m.end(), m.group(2).strip(ENDS)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
        base[i] += [(m.start(), 2, m.end(), m.group().strip(ENDS)) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        base[i] += [(m.start(), 3, m.end(), m.group()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        for m in [*re.finditer("[A-Za-z0-9+/_.-]{12,}", text), *re.finditer("[A-Za-z0-9]{12,}", text)]:
            if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()):
                v = m.group().strip(ENDS)
                at = m.start() + len(m.group()) - len(m.group().lstrip(ENDS))
                if not any(b[0] < at + len(v) and b[2] > at for b in base[i]):
                    bare[i].add((at, at + len(v), v))
    kind = {}
    for spans in base.values():
        for _, k, _, v in spans:
            if looks_live(v):
                kind[v] = min(k, kind.get(v, 9))
    owners, repos = defaultdict(set), defaultdict(set)
    for i, (_, _, lang, source, _) in enumerate(rows):
        for v in [b[3] for b in base[i]] + [b[2] for b in bare[i]]:
            owners[v].add(source)
            repos[v].add((source, lang))
    live = {v for v in kind if len(owners[v]) <= 2 and len(repos[v]) <= 4}
    text_of = lambda spans: ",".join(f"{KINDS[k - 1]}:{a}:{b}" for a, k, b in sorted(spans))
    out = {}
    for i in range(len(rows)):
        own = [b[:3] for b in base[i]]
        more = {(a, kind[v], b) for a, b, v in bare[i] if v in live}
        out[i] = (*[sum(s[1] == k for s in own) for k in (1, 2, 3)], sha(text_of(own)), text_of([*own, *more]), sum(b[3] in live for b in base[i]), sum(b[3] in kind and b[3] not in live for b in base[i]))
    return out


def secret_rows() -> list[tuple]:
    rng = random.Random(5)
    live = ["".join(rng.choice("abcdefgh0123456789XYZ") for _ in range(20)) for _ in range(8)]
    shared = "c0ffee00aa11bb22cc33dd44ee55"
    rows = []
    for i in range(60):
        v = live[i % 8]
        texts = [f"password = '{v}' and {v} again", f"bare {v}.", f"see={v}, /{v}", f"token: {shared}", f"the {shared} value", "api_key=abc", "ApiKey : hunter2", f"x{'AKIA' + 'Q7' * 9} AKIA12", "secret=EXAMPLE12345678", f"é😀 {shared}{shared[:4]}", f"TOKEN={v}= tail", "0123456789abcdef" * 3]
        rows.append((i, " ".join(rng.sample(texts, 4)), rng.choice(["en", "de", None]), f"s{i % 8}" if i % 7 else None, 1))
    return rows


def test_secrets_equal_plain_version(spark: SparkSession) -> None:
    rows = secret_rows()
    got = {r.doc_id: tuple(r)[1:] for r in secrets(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    assert got == {rows[i][0]: v for i, v in plain_secrets(rows).items()}
    assert any(v[4].count(":") > 2 * sum(v[:3]) for v in got.values()), "bare places are found"
    assert any(v[6] for v in got.values()) and any(v[5] for v in got.values())


@pytest.mark.parametrize(("owners", "live"), [(1, True), (2, True), (3, False)])
def test_owners_at_below_and_above_the_bound(spark: SparkSession, owners: int, live: bool) -> None:
    value = "q9w8e7r6t5y4u3i2"
    rows = [(i, f"token={value}" if not i else f"plain {value} text", "en", f"s{i % owners}", 1) for i in range(12)]
    df = spark.createDataFrame(rows, DOCS)
    (one,) = candidates(df).collect()
    assert (one.hash, one.kind, one.owners, one.live) == (sha(value), "assign", owners, live)
    assert sum("assign:6:22" in r.spans for r in secrets(df).collect()) == (11 if live else 0)


def test_secrets_awkward_rows(spark: SparkSession) -> None:
    rows = awkward(spark)
    got = Counter(tuple(r)[:7] + tuple(r)[7:] for r in secrets(with_clashes(spark.createDataFrame(rows, DOCS))).collect())
    want = plain_secrets(rows)
    assert got == Counter((rows[i][0], *want[i]) for i in range(len(rows)))
    assert secrets(spark.createDataFrame([], DOCS)).count() == 0


# --- 12


def plain_manifest(rows: list[tuple], fanout: int = 16) -> Counter:
    def field(x: object) -> str:
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r: tuple, text: str | None) -> str:
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def climb(digests: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
        ways: list[list[tuple[str, str]]] = [[] for _ in digests]
        at = list(range(len(digests)))
        while len(digests) > 1:
            for i, k in enumerate(at):
                run = k // fanout * fanout
                ways[i].append(("".join(digests[run:k]), "".join(digests[k + 1 : run + fanout])))
            digests = [sha("".join(digests[k : k + fanout])) for k in range(0, len(digests), fanout)]
            at = [k // fanout for k in at]
        return digests[0], ways

    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tries = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        tries[s] = climb([leaf(r, r[1]) for r in by_source[s]])
    if not sources:
        return Counter()
    root, above = climb([tries[s][0] for s in sources])
    out: Counter = Counter()
    for k, s in enumerate(sources):
        for r, way in zip(by_source[s], tries[s][1], strict=True):
            own = at = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                at = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for before, after in [*way, *above[k]]:
                at = sha(before + at + after)
            out[(r[0], own, tries[s][0], root, sha("".join(a + b for a, b in [*way, *above[k]])), at, at == root)] += 1
    return out


@pytest.mark.parametrize("counts", [[1], [2, 1], [16, 17, 1], [15, 256, 257], [300] + [1] * 40, []])
def test_manifest_equals_plain_version(spark: SparkSession, counts: list[int]) -> None:
    rng = random.Random(len(counts))
    rows = [(rng.choice([k, k * 4099, -k * (1 << 40)]) * 40 + s, rng.choice(["Abc Def", "xyz", None, ""]), "en", f"s{s}" if s else None, k) for s, n in enumerate(counts) for k in range(n)]
    rng.shuffle(rows)
    got = Counter(map(tuple, verified(spark.createDataFrame(rows, DOCS).repartition(3)).collect()))
    assert got == plain_manifest(rows)


def test_manifest_awkward_rows(spark: SparkSession) -> None:
    rows = awkward(spark) + [(7, "Same again", "en", "hot", 3)] * 700
    got = Counter(map(tuple, verified(with_clashes(spark.createDataFrame(rows, DOCS))).collect()))
    assert got == plain_manifest(rows)
    assert sum(not k[-1] for k in got.elements()) > 0


# --- 13

VECTORS = "vec_id long, embedding array<float>"


def plain_whitening(rows: list[tuple]) -> dict:
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for dim in {len(x) for _, x in kept}:
        fit = [list(x) for x in {tuple(x) for _, x in kept if len(x) == dim}]
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        v = np.cov(np.array(fit, float).T, bias=True).reshape(dim, dim)
        e, vectors = np.linalg.eigh(v)
        for i, x in kept:
            if len(x) == dim:
                away = [n * a - s for a, s in zip(x, sums, strict=True)]
                for k in range(min(4, dim)):
                    at = dim - 1 - k
                    score = np.array([a / n for a in away]) @ vectors[:, at] / math.sqrt(e[at]) if e[at] > 1e-9 * max(e[-1], 1e-300) else None
                    out[(i, k + 1)] = (n, sum(a * a for a in away), None if score is None else abs(score), e[at] / np.trace(v) if np.trace(v) > 0 else None)
    return out


def same_whitening(got: DataFrame, rows: list[tuple]) -> None:
    want, seen = plain_whitening(rows), {}
    for r in got.collect():
        seen[(r.vec_id, r.component)] = r
    assert seen.keys() == want.keys()
    for key, (n, deviation, score, explained) in want.items():
        r = seen[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened is None if score is None else abs(r.whitened) == pytest.approx(score, rel=1e-6, abs=1e-6)
        assert r.explained is None if explained is None else r.explained == pytest.approx(explained, rel=1e-4, abs=1e-12)
        assert score is None or r.identity_error <= 1e-4


def test_whitening_equals_plain_version(spark: SparkSession) -> None:
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same_whitening(Q.op13_embedding_whitening(spark, SF), rows)


@pytest.mark.parametrize("dim", [1, 3, 31, 32, 33, 300])
def test_whitening_of_any_width(spark: SparkSession, dim: int) -> None:
    rng = np.random.default_rng(dim)
    scale = 2.0 ** -np.arange(dim).clip(max=8)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(3, 1, dim) * scale]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    got = whiten(with_clashes(spark.createDataFrame(rows, VECTORS).repartition(7)))
    same_whitening(got, rows)
    signs = defaultdict(set)
    for r in got.collect():
        if r.vec_id == 0 or r.vec_id >= 1000:
            signs[r.component].add(r.whitened)
    assert all(len(s) == 1 for s in signs.values()), "equal vectors, equal scores"


def test_blocks_cover_every_dimension() -> None:
    for dim in (1, 31, 32, 33, 64, 1000, 4096):
        assert [x for a, b in edges(dim) for x in range(a, b)] == list(range(dim))
        assert len(edges(dim)) <= max(8, -(-dim // 32) if dim <= 256 else 8)


def test_whitening_awkward_rows(spark: SparkSession) -> None:
    rows = [(1, None), (2, [1.0, None]), (3, [1.0, math.nan]), (4, [math.inf, 1.0]), (5, []), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [3.0, -0.0]), (8, [0.5, 0.25]), (9, [1.0, 1.0, 1.0]), (10, [2.0, 1.0, 1.0]), (11, [7.0])]
    same_whitening(whiten(spark.createDataFrame(rows, VECTORS)), rows)
    assert whiten(spark.createDataFrame([], VECTORS)).count() == 0
    big = [(1, [1e15, 0.0]), (2, [-1e15, 1.0])]
    assert {r.deviation for r in whiten(spark.createDataFrame(big, VECTORS)).collect()} == {None}
