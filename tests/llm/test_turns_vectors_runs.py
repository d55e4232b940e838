"""Conversation repair, lattice near-dedup and periodic runs against brute force, and on odd tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lattice_hash, near_dedup, periodic_runs, turn_grammar
from ledgerloom.llm.queries import damaged_turns, repeating_documents


def rows(df):
    return df.toArrow().to_pylist()


# 11 conversations

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def least_repair(symbols):
    """(cost, audit) by walking the states start, system, user, assistant turn by turn."""

    def grown(found):
        while True:
            more = dict(found)
            for (state, role), to in NEXT.items():
                if role != "s" and state in found:
                    cost, audit = found[state]
                    more[to] = min(more.get(to, (cost + 3, audit + "I")), (cost + 3, audit + "I"))
            if more == found:
                return found
            found = more

    found = grown({0: (0, "")})
    for symbol in symbols:
        new = {}
        for state, (cost, audit) in found.items():
            options = [(state, 4, "D")]
            if symbol != "d":
                more = 3 if symbol.isupper() else 0
                for role in "sua":
                    if (state, role) in NEXT and (role != "s" or symbol.lower() == "s"):
                        same = symbol.lower() == role
                        options.append((NEXT[state, role], more + (0 if same else 3), "K" if same else "R"))
            for to, price, edit in options:
                step = (cost + price, audit + edit)
                new[to] = min(new.get(to, step), step)
        found = grown(new)
    return min(found[s] for s in (0, 3) if s in found)


def test_charts_find_the_least_repair():
    parser = turn_grammar.Parser(limit=50)
    every = itertools.chain.from_iterable(itertools.product("suaxUd", repeat=n) for n in range(1, 5))
    draw = random.Random(3)
    long = ["".join(draw.choice("suaSUAxXduaua") for _ in range(draw.choice([7, 8, 9, 17, 70]))) for _ in range(200)]
    for word in [*every, *long]:
        assert turn_grammar.cheapest(parser([(s, 0) for s in word])) == least_repair(word), word


def test_repeats_are_deletions():
    parser = turn_grammar.Parser()
    for word, n in itertools.product(["u", "ua", "sxa", "a"], [1, 8, 9, 40]):
        symbols = [(s, n if i == 0 else 0) for i, s in enumerate(word)]
        plain = word[0] + "d" * n + word[1:]
        assert turn_grammar.cheapest(parser(symbols)) == least_repair(plain)


def transcript(turns):
    """Counts, audit and repaired lines of the turns (turn, role, text) of one conversation."""
    turns = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns]
    turns.sort(key=lambda r: (r[0] is not None, r[0], r[1], hashlib.sha256(r[2].encode()).digest()))
    counts, seen, symbols = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols.append("d" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    known = [t for t, _, _ in turns if t is not None]
    counts["gaps"] = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = least_repair(symbols)
    lines, left, before = [], list(turns), ""
    for edit in audit:
        _, role, text = left.pop(0) if edit != "I" else (None, "", "")
        if edit == "D":
            continue
        if edit != "K":
            role = "user" if before != "u" else "assistant"
        before = role[0]
        lines.append(f"{role}:{text}")
    return counts | {"cost": cost, "audit": audit}, lines


TURNS = "conv_id long, turn long, role string, text string"


def judged(turns):
    verdicts = turn_grammar.audit_conversations(turns)
    lines = {}
    for r in sorted(rows(turn_grammar.repaired_turns(turns, verdicts)), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["repaired_sha256"] for r in rows(turn_grammar.transcript_digests(turns, verdicts))}
    return {r.pop("conv_id"): r for r in rows(verdicts)}, lines, digests


def check(spark, table):
    got, lines, digests = judged(spark.createDataFrame(table, TURNS).withColumns({c: F.lit("x") for c in ("conv", "at", "audit", "n", "kind")}))
    convs = {}
    for conv, *rest in table:
        convs.setdefault(conv, []).append(tuple(rest))
    assert set(got) == set(convs) == set(digests)
    for conv, turns in convs.items():
        want, text = transcript(turns)
        assert got[conv] == want, conv
        assert lines.get(conv, []) == text
        assert digests[conv] == hashlib.sha256("\n".join(text).encode()).hexdigest()


def test_repair_of_random_conversations(spark):
    draw = random.Random(4)
    table = []
    for conv in range(150):
        for turn in range(draw.choice([0, 1, 3, 6, 11])):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = draw.choice(["Yes.", "No", "", None, " \n", f"text {draw.randrange(9)}. ", f"cut {draw.randrange(9)}"])
            table += [(conv, draw.choice([turn, turn, 2 * turn, None]), role, text)] * draw.choice([1, 1, 1, 2])
    table += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello!"), (None, 1, "assistant", "Hello!")]
    check(spark, table)


def test_a_conversation_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(turn_grammar, "PIECE", 16)
    monkeypatch.setattr(turn_grammar, "FAN", 4)
    draw = random.Random(5)
    table = [(7, t, draw.choice(["user", "assistant", "system"]), f"t{draw.randrange(600)}{draw.choice('.?!,')}") for t in range(700)]
    table += [(8, 3, "user", "again.")] * 300 + [(9 + i, t, "user", f"{i} {t}.") for i in range(60) for t in range(3)]
    check(spark, table)


def test_repair_of_no_turns(spark):
    none = spark.createDataFrame([], TURNS)
    verdicts = turn_grammar.audit_conversations(none)
    assert verdicts.count() == 0 and turn_grammar.repaired_turns(none, verdicts).count() == 0
    assert turn_grammar.transcript_digests(none, verdicts).count() == 0


def test_damage_follows_the_checksum(spark):
    table = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = {}
    for r in rows(damaged_turns(spark.createDataFrame(table, TURNS))):
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for conv, turn, role, text in table:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: None, 1: [(role, "")], 2: [(role, text.translate({ord(c): None for c in ".!?"}))], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert got.get((conv, turn)) == want.get(fault, [(role, text)])


# 12 vectors


def test_lattice_vectors_and_decoding():
    near = lattice_hash.neighbours()
    assert [int(((near**2).sum(1) == n).sum()) for n in (0, 2, 4)] == [1, 240, 2160] and len(near) == 2401
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 8)) * 3
    best = lattice_hash.decode(x)
    assert (((best * 2) % 2 == ((best * 2) % 2)[:, :1]).all() and (best.sum(1) % 2 == 0).all())
    away = ((x[:, None] - best[:, None] - near[None]) ** 2).sum(2)
    assert (away.argmin(1) == 0).all() and (away[:, 0] <= 1 + 1e-9).all()  # nearest, within the covering radius


def brute_links(table, threshold):
    """Links and components of (id, vector, label) by all pairs."""
    sound = {}
    for i, (key, vector, label) in enumerate(table):
        if key is not None and label is not None and vector and None not in vector and np.isfinite(vector).all() and any(vector):
            v = np.asarray(vector, np.float32).astype(float)
            v /= np.abs(v).max()
            sound[i] = (label, len(v), v / np.sqrt(v @ v))
    links, root = {i: 0 for i in range(len(table))}, list(range(len(table)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sound, 2):
        if sound[a][:2] == sound[b][:2] and sound[a][2] @ sound[b][2] >= threshold:
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    least = {}
    for i, (key, _, _) in enumerate(table):
        r = find(i)
        least[r] = key if least.get(r) is None else min(least[r], key)
    return [(key, links[i], least[find(i)] if key is not None else None) for i, (key, _, _) in enumerate(table)]


def check_vectors(spark, table, threshold=0.98):
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    df = df.withColumns({c: F.lit("x") for c in ("id", "k", "h", "lo", "vector", "cell", "a.b", "kept")})
    got = rows(lattice_hash.near_duplicate_vectors(df, threshold=threshold))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(brute_links(table, threshold), key=key)


def test_links_at_the_threshold(spark):
    draw = np.random.default_rng(2)
    table = []
    for cosine in (0.9801, 0.981, 0.985, 0.9799, 0.97, 0.9):
        for _ in range(150):
            x, g = draw.normal(size=(2, 64))
            x /= np.linalg.norm(x)
            g -= (g @ x) * x
            g /= np.linalg.norm(g)
            y = cosine * x + np.sqrt(1 - cosine**2) * g
            table += [(len(table), x.tolist(), 1), (len(table) + 1, (3 * y).tolist(), 1)]
    check_vectors(spark, table)


@pytest.mark.parametrize("dims", [3, 24, 100])
def test_links_in_other_dimensions(spark, dims):
    draw = np.random.default_rng(3)
    table = [(i, v.tolist(), i % 2) for i, v in enumerate(draw.normal(size=(300, dims)))]
    table += [(1000 + i, (np.array(v) + draw.normal(size=dims) * 0.04).tolist(), label) for i, v, label in table[:150]]
    check_vectors(spark, table)


def test_a_group_of_a_third_of_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(lattice_hash, "PIECE", 32)
    draw = np.random.default_rng(4)
    centre = draw.normal(size=64)
    table = [(i, (centre + draw.normal(size=64) * 0.12).tolist(), 5) for i in range(250)]
    table += [(300 + i, table[0][1], 5) for i in range(200)] + [(600 + i, draw.normal(size=64).tolist(), 5) for i in range(300)]
    check_vectors(spark, table)


def test_odd_vectors(spark):
    one = [1.0, 0.0, 2.0, 0.5] * 4
    table = [
        (1, one, 1), (1, one, 1), (1, [-x for x in one], 1), (2, one, 2), (3, one, None), (None, one, 1), (4, None, 1), (5, [], 1),
        (6, [0.0] * 16, 1), (7, [None] * 16, 1), (8, [float("nan")] * 16, 1), (9, [float("inf")] * 16, 1), (10, one * 2, 1),
        (11, [1e30 * x for x in one], 1), (12, [-0.0 if x == 0 else x for x in one], 1), (13, [2.0], 1), (14, [5.0], 1), (15, [-5.0], 1),
    ]
    check_vectors(spark, table)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lattice_hash.near_duplicate_vectors(none).count() == 0


# 13 runs


def brute_runs(word, least=12):
    """Runs by comparing the sequence with itself at every distance."""
    found = {}
    for p in range(1, len(word) // 2 + 1):
        i = 0
        while i + p < len(word):
            j = i
            while j + p < len(word) and word[j] == word[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def test_runs_of_random_words():
    draw = random.Random(6)
    for _ in range(600):
        word = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randrange(60))]
        if word and draw.random() < 0.5:
            a, p = draw.randrange(len(word)), draw.randrange(1, 8)
            word = [word[i if i < a or i < a + p else a + (i - a) % p] for i in range(len(word))]
        for least in (2, 5, 12):
            assert periodic_runs.runs_of(word, least) == brute_runs(word, least)
        counts, found, _ = periodic_runs._judge(pa.array([" ".join(map(str, word)), None, "x"]))
        assert found[0] == brute_runs(word) and counts.tolist() == [len(word), 0, 1]


def test_paths_are_recoloured_from_the_root():
    draw = random.Random(7)
    parent = [-1] + [draw.randrange(i) for i in range(1, 200)]
    paths, colour = periodic_runs.RootPaths(parent), [-1] * 200
    for turn in range(2000):
        x = draw.randrange(200)
        chain = [x]
        while parent[chain[-1]] >= 0:
            chain.append(parent[chain[-1]])
        want = [(a, colour[a]) for i, a in enumerate(chain) if colour[a] >= 0 and (i == 0 or colour[chain[i - 1]] != colour[a])]
        assert paths.access(x, turn) == want
        for a in chain:
            colour[a] = turn


def collapsed(words, found):
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def test_runs_on_odd_documents(odd_documents, no_documents):
    odd = odd_documents.withColumns({"a.b": F.lit(1), "x`y": F.lit(2), "runs": F.lit(3), "row": F.lit(4)})
    got = rows(periodic_runs.find_runs(odd))
    assert len(got) == odd.count() and {"a.b", "x`y", "row", "source"} <= set(got[0])
    texts = {(r["doc_id"], r["text"]) for r in rows(odd.select("doc_id", "text"))}
    want = []
    for i, text in texts:
        words = (text or "").split()
        want.append((i, len(words), brute_runs(words) if len(words) < 5000 else None, words))
    for r in got:
        mine = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
        assert any(
            i == r["doc_id"] and n == r["n_words"] and (found is None or (mine == found and r["collapsed"] == collapsed(words, found)))
            for i, n, found, words in want
        )
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in mine).encode()).hexdigest()
    periodic = next(r for r in got if r["doc_id"] == 10)
    assert [tuple(x.values()) for x in periodic["runs"]] == [(0, 60_000, 4001)]
    assert periodic_runs.find_runs(no_documents).count() == 0


def test_planted_repeats(spark):
    texts = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)] + [(None, "a b c"), (1, None)]
    got = {(r["doc_id"], r["text"]) for r in rows(repeating_documents(spark.createDataFrame(texts, "doc_id long, text string")))}
    want = set()
    for i, text in texts:
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        words = (text or "").split()
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[j] if j < a else words[a + (j - a) % p] for j in range(n))
        elif h % 10 == 0:
            text = None
        want.add((i, text))
    assert {(i, t or None) for i, t in got} == {(i, t or None) for i, t in want}


def test_components_join_what_tasks_found(spark, tmp_path):
    links = spark.createDataFrame([(5, 3), (3, 1), (9, 8)], "u long, c long")
    tables = near_dedup._Tables(spark)
    assert sorted(map(tuple, near_dedup.components(links, tables.keep).collect())) == [(1, 1), (3, 1), (5, 1), (8, 8), (9, 8)]
