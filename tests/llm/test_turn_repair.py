import hashlib
import itertools
import random
import re
import zlib

import pytest

from seqledger.llm import turn_repair as r

SCHEMA = "conv_id long, turn long, role string, text string, cid string, audit string, mark long"


def table(spark, rows):
    return spark.createDataFrame([(*x, "c", "a", 1) for x in rows], SCHEMA)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = re.findall("[^\x20\x09-\x0D]", text)
        kind = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def all_repairs(rows, kinds):
    """Every repair with few insertions, by trying all of them: (cost, audit, lines)."""
    def edits(i):
        role, text = rows[i]
        more = 1 if kinds[i] == "truncated" else 0
        out = [("D", 3, None)]
        if kinds[i] not in ("blank", "duplicate"):
            out += [("K", more, (role, text))] + [("R", 2 + more, (new, text)) for new in ("user", "assistant")]
        return out

    inserts = [(), *[(x,) for x in ("user", "assistant")], ("user", "assistant"), ("assistant", "user")]
    best = None
    for choice in itertools.product(*[edits(i) for i in range(len(rows))]):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(c for _, c, _ in choice) + 2 * sum(map(len, places))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for i, extra in enumerate(places):
                audit += "I" * len(extra)
                lines += [(x, "") for x in extra]
                if i < len(rows):
                    audit += choice[i][0]
                    lines += [choice[i][2]] if choice[i][2] else []
            if all(a for a, _ in lines) and re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in lines)):
                found = (cost, audit, lines)
                best = found if best is None or found[:2] < best[:2] else best
    return best


def lightest(rows, kinds):
    """The same by a table over rows and states; for longer conversations."""
    code = {"": r.SOUND, "blank": r.BLANK, "duplicate": r.DUPLICATE, "truncated": r.CUT_OFF}
    states = {0: (0, "")}
    make, ends = {0: 2, 1: 2, 2: 3, 3: 2}, (0, 3)

    def inserted(s):
        for _ in range(3):
            for q, (c, a) in list(s.items()):
                new = (c + 2, a + "I")
                if make[q] not in s or new < s[make[q]]:
                    s[make[q]] = new
        return s

    for (role, _), kind in zip(rows, kinds, strict=True):
        after = {}
        for q, (c, a) in inserted(states).items():
            options = [(q, c + 3, a + "D")]
            if code[kind] not in (r.BLANK, r.DUPLICATE):
                more = kind == "truncated"
                keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                options += [(keep, c + more, a + "K")] if keep is not None else []
                options += [(make[q], c + more + 2, a + "R")]
            for p, *w in options:
                if p not in after or tuple(w) < after[p]:
                    after[p] = tuple(w)
        states = after
    return min(w for q, w in inserted(states).items() if q in ends)


def lines_of(rows, audit):
    out, i, state = [], 0, ""
    for edit in audit:
        role, text = rows[i] if edit != "I" else (None, "")
        i += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == "u" else "user"
        state = role[0]
        out.append(f"{role}:{text}")
    return "\n".join(out)


def plain(conversations):
    out = {}
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{x[1]}:{x[2]}".encode()).digest()))
        body = [(role, text) for _, role, text in rows]
        kinds = faults(body)
        turns = {t for t, _, _ in rows if t is not None}
        initials = [a[:1] for a, _ in body]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit = lightest(body, kinds)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
                     illegal, cost, audit, hashlib.sha256(lines_of(body, audit).encode()).hexdigest())
    return out


def result(df):
    return {x[0]: tuple(x)[1:] for x in df.collect()}


ROLES = ["user", "assistant", "system", "a", "tool", ""]


@pytest.mark.parametrize("seed", range(6))
def test_the_agenda_finds_what_trying_all_repairs_finds(seed):
    rng = random.Random(seed)
    for _ in range(12):
        rows = [(rng.choice(ROLES), rng.choice(["x.", "y", "", "z!"])) for _ in range(rng.randint(0, 3))]
        kinds = faults(rows)
        cost, audit, lines = all_repairs(rows, kinds)
        assert (cost, audit) == lightest(rows, kinds)
        assert "\n".join(f"{a}:{b}" for a, b in lines) == lines_of(rows, audit)


def test_conversations_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(r, "WINDOW", 5)
    rng = random.Random(9)
    texts = ["a.", "b", " ", "c!", "d?\n", "e ", "é.", "x y z"]
    conversations = {i: [(rng.choice([None, *range(9)]), rng.choice(ROLES), rng.choice(texts)) for _ in range(rng.randint(1, 14))] for i in range(60)}
    conversations[None] = [(0, "user", "hi."), (1, "assistant", "long " * 50_000)]
    conversations[500] = [(t, rng.choice(ROLES), rng.choice(texts) + str(t)) for t in range(400)]
    rows = [(c, *x) for c, xs in conversations.items() for x in xs]
    rng.shuffle(rows)
    assert result(r.repair(table(spark, rows).repartition(3))) == plain(conversations)


def test_damage_and_conversations_that_lose_all_rows(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["one. two!", "x?", None])) for c in [None, *range(80)] for t in [None, *range(3)]]
    hurt = {c: [] for c in [None, *range(80)]}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        hurt[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    turns = table(spark, rows)
    want = plain(hurt)
    assert result(r.repair(r.damage(turns), turns)) == want
    gone = next(c for c in range(80, 10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = table(spark, [(gone, 0, "user", "x.")])
    assert result(r.repair(r.damage(one), one)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table(spark):
    none = table(spark, [])
    assert r.repair(r.damage(none), none).collect() == [] and r.repair(none).collect() == []
