import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiforge.llm import fillin, simhash, variants

#: Further columns whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, word string, n long, fp long, c long, key string, piece int, print string, form string, cuts string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, "k", 4, "p", "f", "x") for i, t in rows], SCHEMA)


def prose(rng, n, letters="abcdeé"):
    return " ".join("".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(n))


# 11


def words_of(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def variants_of(rows):
    """Every word against every word."""
    words = words_of(rows)

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [x for x in words if near(w, x)] for w in words}
    best = {w: min(c, key=lambda x: (-words[x], x)) if c else None for w, c in close.items()}
    form = {w: b if b and words[b] >= 10 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(close[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


@pytest.mark.parametrize("seed", range(3))
def test_variants_against_brute_force(spark, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    stems = ["".join(rng.choice(list("abÀ"), rng.integers(6, 9))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    listed = []
    for s in stems:
        listed += [s] * int(rng.choice([2, 3, 25, 260]))
        for _ in range(3):
            i = int(rng.integers(len(s)))
            listed += [str(rng.choice([s[:i] + s[i + 1 :], s[:i] + "b" + s[i:], s[:i] + "cè"[int(rng.integers(2))] + s[i + 1 :]]))] * int(rng.integers(1, 4))
    rng.shuffle(listed)
    rows = [(i, "1. ".join(x.upper() if i % 7 == 0 and x.isascii() else x for x in listed[i * 9 : i * 9 + 9])) for i in range(len(listed) // 9)]
    rows += [(None, "Nullwords nullwords"), (5, None), (6, ""), (7, "×÷ short"), (3, rows[3][1]), (3, rows[3][1])]
    got = [tuple(r) for r in variants.variants(docs_of(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == variants_of(rows)
    assert any(g[1] for g in got) and any(g[4] > 1 for g in got)


def test_long_words_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK_CHARS", 1000)
    long = "x" * 200_000
    rows = [(i, f"{long} {long}y {long[:-1]} ordinary") for i in range(40)]
    got = {(len(r["word"]), r["word"][-1]): r for r in variants.variants(docs_of(spark, rows)).collect()}
    want = words_of(rows)
    assert len(got) == len(want) and got[200_000, "x"]["n"] == want[long]
    # Shorter, longer by y, and the few rows whose words lost a letter.
    assert got[200_000, "x"]["n_near"] == sum(1 for w in want if w != long and abs(len(w) - len(long)) <= 1 and (w.strip("x") in ("", "y")))
    assert variants.variants(docs_of(spark, [])).isEmpty()
    assert variants.variants(docs_of(spark, [(1, None), (None, "few")])).isEmpty()


def test_prefix_nodes_do_not_depend_on_the_block():
    rng = np.random.Generator(np.random.PCG64(2))
    words = ["".join(rng.choice(list("abcé"), rng.integers(7, 12))) for _ in range(3000)]
    seen = {}
    for part in (words, words[::-1], words[:7], words[5:6]):
        of, place, node, code = variants.prefixes(part)
        for w, i, x, c in zip(of, place, node, code, strict=True):
            assert seen.setdefault(part[w][:i], x) == x
            assert c == (ord(part[w][i]) if i < len(part[w]) else 0)
    assert len(set(seen.values())) == len(seen)


# 12


def print_of(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(nodes, bits=3, tied=()):
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    listed = sorted(nodes)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= bits or (a, b) in tied:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {x: find(x) for x in nodes}


def test_fingerprints_of_whole_texts(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(3))
    texts = ["", " \n", "one", "one Two", "a b c", prose(rng, 300), "É" + prose(rng, 50) + "\x0b\x0cx y z", "word " * 500, "x" * 5000 + " y z w"]
    for size in (1 << 20, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert [int(simhash.fingerprint(t.encode())) for t in texts] == [print_of(t) for t in texts]


@pytest.mark.parametrize("agree", [2, 3, 4])
def test_alike_fingerprints_share_a_key_and_survive(agree):
    rng = np.random.Generator(np.random.PCG64(4))
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
    assert (simhash.keys(a, 3, agree) == simhash.keys(b, 3, agree)).any(axis=1).all()
    both, n = np.concatenate([a, b, rng.integers(0, 2**64, 4000, dtype=np.uint64)]), len(a)
    assert len(simhash.survivors(both, np.arange(n), np.arange(n, 2 * n), 3)[0]) == n
    assert len(simhash.survivors(both, np.arange(n), np.arange(2 * n, 3 * n), 3)[0]) == 0
    assert int(np.bitwise_or.reduce(simhash.segments(3, agree))) == 2**64 - 1 == sum(map(int, simhash.segments(3, agree)))


@pytest.mark.parametrize("block, least", [(1024, 500), (3, 5)])
def test_links_against_brute_force(spark, tmp_path, monkeypatch, block, least):
    """Chains, a dense group around a middle that isn't the commonest, and strangers."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(simhash, "HOT_LEAST", least)
    rng = np.random.Generator(np.random.PCG64(5))
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    nodes = {int(x) for x in rng.integers(0, 2**64, 150, dtype=np.uint64)} | {0}
    middle = int(rng.integers(0, 2**63))
    nodes |= {flip(middle, int(rng.integers(1, 7))) for _ in range(250)}
    x = int(rng.integers(0, 2**63))
    for _ in range(40):
        nodes.add(x := flip(x, 3))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    table = spark.createDataFrame([(signed(v), 1 + v % 3, i) for i, v in enumerate(sorted(nodes))], "fp long, c long, least long")
    found = simhash.links(table, spark.createDataFrame([], "a long, b long"), str(tmp_path)).collect()
    got = {r["node"] % 2**64: r["component"] % 2**64 for r in found}
    groups, own = defaultdict(set), components_of(nodes)
    for v in nodes:
        groups[got.get(v, v)].add(v)
    want = defaultdict(set)
    for v, c in own.items():
        want[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, want.values())) > 100


def test_simhash_of_documents(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    base = prose(rng, 400)
    rows = [(i + 10, prose(rng, 60)) for i in range(40)]
    rows += [(i + 100, base.replace(" ", "  ", i)) for i in range(5)] + [(200 + i, " ".join([*base.split()[:-1], f"end{i}"])) for i in range(5)]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "One"), (7, rows[0][1]), (7, rows[1][1]), (None, base), (9, "w " * 400_000), (10, rows[0][1])]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    prints = {(i, t): print_of(t) if len(t or "") < 10**5 else None for i, t in rows}
    assert len(got) == len(rows)
    own = Counter((r["doc_id"], int(r["fingerprint"], 16)) for r in got)
    assert all(own[i, p] for (i, _), p in prints.items() if p is not None) and all(len(r["fingerprint"]) == 16 for r in got)
    named = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in got}
    assert named[None, print_of(base)] is None
    nodes = {p for i, p in named if i is not None}
    tied = {tuple(sorted(p for i, p in named if i == 7))}
    top = components_of(nodes, tied=tied)
    least = {}
    for i, p in named:
        if i is not None:
            least[top[p]] = min(least.get(top[p], i), i)
    assert all(c == least[top[p]] for (i, p), c in named.items() if i is not None)
    assert named[2, 0] == named[3, 0] == named[1, 0] == 1 and len({c for (i, _), c in named.items() if i and 100 <= i < 105}) == 1
    assert simhash.near_duplicates(docs_of(spark, [])).isEmpty()


# 13


def cut_of(i, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, len(t), "plain", None, None, sha(t), sha(t)
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if h4 % 100 < 20 else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return i, len(t), "spm" if h4 % 100 < 20 else "psm", a, b - a, sha(out), sha(t)


@pytest.mark.parametrize("giant, piece", [(1 << 16, 1 << 14), (40, 7), (0, 1)])
def test_cuts_against_slices(spark, giant, piece):
    rng = np.random.Generator(np.random.PCG64(8))
    bits = ["a", "é", "中", "🙂", "<", "<P", "P>", "<Q>", "S", "\n", "\u0000", "‍", "é"]
    rows = [(i, "".join(rng.choice(bits, rng.integers(0, 60)))) for i in range(150)]
    rows += [(500 + i, f"{prose(rng, 5)}{m}{prose(rng, 3)}") for i, m in enumerate(("<P>", "<S>", "<M>", "<p>", "<<M>>", "< P>"))]
    rows += [(None, "null é id"), (None, None), (601, None), (602, ""), (603, "<M>"), (604, "x"), (604, "x"), (604, "other"), (-3, "minus")]
    if giant >= 40:
        rows += [(700 + i, prose(rng, 15_000)) for i in range(4)] + [(710, "🙂" * 40_000), (711, "a" * 70_000 + "<S>"), (712, "é" * 8192 + "z" * 60_000)]
    got = fillin.transformed(docs_of(spark, rows), giant=giant, piece=piece)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    got = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")), sha(fillin.restored(F.col("output"), F.col("form")))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((cut_of(i, t) for i, t in rows), key=str)


def test_no_documents_no_cuts(spark):
    assert fillin.digests(docs_of(spark, [])).isEmpty()
    assert fillin.digests(docs_of(spark, [])).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_functions_compose_from_any_cut():
    """The function of a text is that of its parts, wherever it is cut, malformed bytes included."""
    rng = np.random.Generator(np.random.PCG64(9))
    scan = lambda parts: fillin.Scan(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])).functions()
    for _ in range(60):
        raw = bytes(rng.choice([60, 80, 62, 83, 0x80, 0xC3, 0xE4, 0xF0, 97], int(rng.integers(0, 1500))).astype(np.uint8))
        cuts = sorted(rng.integers(0, len(raw) + 1, 5).tolist())
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        ends, units = fillin.composed(*scan(parts), np.arange(len(parts)))
        whole = scan([raw])
        assert (ends[-1] == whole[0][0]).all() and (units[-1] == whole[1][0]).all()
        state, n = (0, 0, False), 0
        for b in raw:
            state, unit = fillin._step(state, b)
            n += unit
        assert whole[1][0][0] == n and fillin._FOUND[whole[0][0][0]] == (re.search(b"<[PSM]>", raw) is not None)


def test_cuts_of_sliced_arrays():
    ids, texts = pa.array([1, 2, 3, None]).slice(1), pa.array([b"skip", b"one", None, b"\xc3\xa9t\xc3\xa9"], pa.binary()).slice(1)
    assert [r["n"] for r in fillin._cut(ids, texts).to_pylist()] == [3, 0, 3]
