"""Filter audit, conversation repair and cap filters against plain versions and SQL, and
their edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from matchbook.llm.cap_filters import design, embedding_links, unit
from matchbook.llm.conversation_repair import repair
from matchbook.llm.filter_audit import audit
from matchbook.llm.queries import OP12_SQL

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in BLANKS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


# --- 11: filter audit

DOC = "doc_id long, text string, lang string, fails int, n string"


def plain_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, _ in docs:
        t = t or ""
        w = words_of(t)
        fails.append((len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t]))
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    rows = {}
    for part in {lang or "" for _, _, lang in docs}:
        own = [(i, f) for (i, _, lang), f in zip(docs, fails, strict=True) if (lang or "") == part]
        total = Counter()
        for order in permutations(range(5)):
            name, left = "".join("ABCDE"[k] for k in order), own
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[k]]
                left = [x for x in left if not x[1][k]]
                total[k] += len(gone)
                rows[part, name, step] = [len(left), len(gone), sum(f[k] for _, f in own) - len(gone), sum(f[k] and sum(f) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), k]
        for key in rows:
            if key[0] == part:
                rows[key][6] = total[rows[key][6]]
    return {k: tuple(v) for k, v in rows.items()}


def test_filter_audit_equals_walks(spark):
    long = " ".join(f"w{i}" for i in range(120))
    texts = ["", None, "A", "x", long, long, long + " #", long.upper(), "same " * 150, "same " * 150, long + "\x0b\x0c é ", "Ä" * 30 + "AB", "a\tb", "日本 𝒳" * 50, " ", "x" * 70000, long, "A x | y"]
    docs = [(i, t, ["de", None, "", "en"][i % 4]) for i, t in enumerate(texts)]
    docs += [(None, long, "de"), (None, "x", "fr"), (4, long, "de"), (2, "x", "en")]  # no id, a repeated row, a repeated id
    labels = [(0, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (8, 1, None), (16, 1, 1), (99, 1, 1), (None, 1, 1), (2, 1, 0)]
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], DOC).repartition(3)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == plain_audit(docs, labels)
    assert audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    none = audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("good_lost + toxic_lost > 0")
    assert none.isEmpty()


# --- 12: conversation repair

ROWS = "conv_id long, turn long, role string, text string, audit string, letter int"


def cheapest(rows):
    """All edit sequences of little cost, shortest first: (cost, audit, lines)."""
    best = {(0, ""): (0, "", [])}
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    new = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def put(key, cost, edits, lines):
        if key not in best or (cost, edits) < best[key][:2]:
            best[key] = (cost, edits, lines)
            return True
        return False

    for i in range(len(rows) + 1):
        for _ in range(3):
            for s in ("", "s", "u", "a"):
                if (i, s) in best:
                    c, e, ls = best[i, s]
                    put((i, new[s]), c + 3, e + "I", [*ls, full[new[s]] + ":"])
        if i == len(rows):
            break
        role, text, fault = rows[i]
        for s in ("", "s", "u", "a"):
            if (i, s) not in best:
                continue
            c, e, ls = best[i, s]
            put((i + 1, s), c + 4, e + "D", ls)
            if fault in "bd":
                continue
            extra = 3 * (fault == "t")
            if role[:1] in after[s]:
                put((i + 1, role[:1]), c + extra, e + "K", [*ls, f"{role}:{text}"])
            put((i + 1, new[s]), c + extra + 3, e + "R", [*ls, f"{full[new[s]]}:{text}"])
    return min(best[len(rows), s] for s in ("", "a") if (len(rows), s) in best)


def plain_repair(rows):
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        by[conv]
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        if draw == 4:
            role = "user"
        by[conv] += [] if draw == 0 else [(turn, role, text)] * (2 if draw == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in own:
            shown = text.strip(BLANKS)
            fault = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "o"
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = Counter(f for *_, f in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))  # noqa: B905
        cost, edits, lines = cheapest(judged)
        out[conv] = (gaps, count["b"], count["d"], count["t"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(4)
    return {r["conv_id"]: tuple(r)[1:] for r in repair(df).collect()}


def test_conversation_repair_equals_search(spark):
    rng = np.random.default_rng(5)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "Use", "agent"], ["Yes.", "no", "", None, " \n", "Why? \t", "é!\x0b", "a\x1c", "Yes.", "x."]
    rows = []
    for conv in range(160):
        for turn in range(int(rng.integers(1, 9))):
            t = None if rng.random() < 0.05 else turn + int(rng.random() < 0.1)
            usual = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else roles[rng.integers(len(roles))]
            rows.append((conv, t, usual, f"{turn}." if rng.random() < 0.5 else texts[rng.integers(len(texts))]))
    rows += [(None, None, None, None), (None, 3, "user", "hi!"), (999, 0, "user", "a."), (999, 0, "user", "a.")]
    rows += [(1000, t, ["user", "assistant"][t % 2], f"line {t}. " * 3) for t in range(3000)]  # one long conversation
    lost = next(c for c in range(2000, 9000) if zlib.crc32(f"{c}:5".encode()) % 20 == 0)
    rows.append((lost, 5, "user", "gone."))
    got, want = repaired(spark, rows), plain_repair(rows)
    assert got == want
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert spark.createDataFrame([], ROWS).transform(repair).count() == 0
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows if r[0] != 1000])
    assert {r[0]: r[1:] for r in con.execute(OP12_SQL).fetchall()} == {k: v for k, v in want.items() if k != 1000}


# --- 13: cap filters

VEC = "vec_id long, embedding array<double>, links long, root string"


def plain_links(rows, cosine):
    """vec_id -> (links, component) by all pairs."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, v in ok:
        by[len(v)].append((i, v))
    for same in by.values():
        x = unit(np.array([v for _, v in same]))
        for a, b in np.argwhere(np.triu(x @ x.T >= cosine, 1)):
            i, j = same[a][0], same[b][0]
            links[i] += 1
            links[j] += 1
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return {i: (links[i], find(i)) for i, _ in rows}


def near(rng, v, cosine):
    y = rng.standard_normal(len(v))
    y -= y @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


@pytest.mark.parametrize("block", [8192, 40])
def test_embedding_links_equal_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(24)) for i in range(300)]
    hot = rng.standard_normal(24)
    rows += [(1000 + i, near(rng, hot, 0.99)) for i in range(200)]  # near copies, all of each other
    rows += [(2000 + i, hot * 3.0) for i in range(150)]  # copies
    rows += [(3000 + i, near(rng, rows[i][1], 0.97) * 10.0 ** (i % 9)) for i in range(60)]
    rows = [(i, v.tolist()) for i, v in rows]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [None] + [1.0] * 23), (5004, [float("nan")] * 24), (5005, [float("inf")] * 24), (5006, [1e300] * 24), (5007, [1e-300] * 24), (5008, [1.0, 2.0]), (5009, [2.0, 4.0]), (5010, [1.0]), (5011, [1e308, -1e308])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], VEC).repartition(3)
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_links(df, 0.95, block=block).collect()}
    want = plain_links(rows + odd, 0.95)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in got), "no link below the threshold"
    # links that are not at the threshold are practically all found
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert np.mean([got[i][1] == want[i][1] and got[i][2] == (want[i][1] == i) for i in got]) >= 0.99
    assert [got[i] for i in (5000, 5001, 5002, 5003, 5004, 5005)] == [(0, i, True) for i in (5000, 5001, 5002, 5003, 5004, 5005)]
    assert got[5006] == (1, 5006, True) and got[5007] == (1, 5006, False) and got[5009] == (1, 5008, False) and got[5010] == (0, 5010, True)


def test_embedding_links_of_little(spark):
    same = spark.createDataFrame([(None, [1.0, 0.0], 1, "x"), (7, [1.0, 0.0], 1, "x"), (7, [1.0, 0.0], 1, "x"), (7, [0.0, 1.0], 1, "x"), (9, [0.0, 2.0], 1, "x")], VEC)
    got = sorted(embedding_links(same).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, 0, None, False), (7, 1, 7, True), (7, 1, 7, True), (7, 1, 7, True), (9, 1, 7, False)], key=str)
    assert embedding_links(same.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1000, 1_000_000])
def test_recall_at_the_threshold(n):
    """Fresh pairs at just 0.95 share a filter as often as designed; so do unlike vectors rarely."""
    made = design(n, 64, 0.95)
    rng = np.random.default_rng(99)
    x = unit(rng.standard_normal((800, 64)))
    y = np.stack([near(rng, v, 0.95) for v in x])
    (i, f), (j, g) = made.decode(x), made.decode(unit(y))
    both = set(zip(i.tolist(), f.tolist(), strict=True)) & set(zip(j.tolist(), g.tolist(), strict=True))
    assert len({r for r, _ in both}) >= 0.97 * len(x)
    assert len(f) / len(x) < 40
    far = set(zip(i.tolist(), f.tolist(), strict=True)) & set(zip(((j + 1) % 800).tolist(), g.tolist(), strict=True))
    assert len({r for r, _ in far}) < (0.6 if n == 1000 else 0.02) * len(x)
