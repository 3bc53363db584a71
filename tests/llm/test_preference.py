import random

from seqledger.llm.preference import conversations, format_pairs, swapped_replies

TURN = "array<struct<turn: long, role: string, text: string>>"


def line(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def plain(chosen, rejected):
    c, r = ([(a or "", b or "") for _, a, b in x or []] for x in (chosen, rejected))
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1

    def rest(turns):
        out, spans = "", []
        for role, text in turns[n:]:
            piece = line(role, text)
            if role == "assistant":
                end = len(out) + len(piece) - 1
                spans.append(f"{end - len(text) - 10}-{end}")
            out += piece
        return out, ",".join(spans)

    (a, sa), (b, sb) = rest(c), rest(r)
    return n, "".join(line(*t) for t in c[:n]), a, b, sa, sb


def test_pairs_are_formatted_as_defined(spark):
    rng = random.Random(3)
    turn = lambda i: (i, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "bé", "", None]))
    rows = []
    for i in range(120):
        c = [turn(k) for k in range(rng.randint(0, 5))]
        r = c[: rng.randint(0, len(c))] + [turn(9) for _ in range(rng.randint(0, 3))]
        rows.append((i, c, r, "x"))
    rows += [(None, rows[0][1], None, "x"), (5, None, None, "x"), (500, [(0, "assistant", "z" * 200_000)], [], "x")]
    out = format_pairs(spark.createDataFrame(rows, f"pair_id long, chosen {TURN}, rejected {TURN}, prompt string")).collect()
    got = sorted((tuple(r) for r in out), key=repr)
    assert got == sorted(((i, *plain(c, r)) for i, c, r, _ in rows), key=repr)


def test_trained_places_hold_the_reply_and_its_end(spark):
    row = format_pairs(spark.createDataFrame([(1, [(0, "user", "q"), (1, "assistant", "réply")], [(0, "user", "q")])],
                                             f"pair_id long, chosen {TURN}, rejected {TURN}")).first()
    start, end = map(int, row["chosen_spans"].split("-"))
    assert row["chosen"][start:end] == "réply<|im_end|>" and row["rejected"] == "" and row["n_common"] == 1


def test_turns_of_a_conversation_are_ordered_and_repeats_count_once(spark):
    rows = [(1, 2, "user", "b", 0), (1, 1, "user", "a", 0), (1, 1, "user", "a", 0), (None, 0, "user", "x", 0), (1, None, None, None, 0)]
    (got,) = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")).collect()
    assert [t["text"] for t in got["turns"]] == ["", "a", "b"]


def test_neighbours_lend_their_last_reply(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "good"), (2, 2, "user", "ok"), (3, 0, "user", "r"), (3, 1, "assistant", "bad"), (4, 0, "user", "alone")]
    pairs = swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r["pair_id"]: r for r in format_pairs(pairs).collect()}
    assert set(out) == {2, 3}
    assert out[2]["prompt"] == line("user", "q") and out[2]["rejected"] == line("assistant", "bad")
    assert out[2]["chosen"] == line("assistant", "good") + line("user", "ok")


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_pairs(swapped_replies(none)).collect() == []
