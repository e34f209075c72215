import random

import pytest

from skein.llm import quotes
from skein.llm.quotes import conversations, op3_quote_links, reply_order

SCHEMA = "conv_id long, turn long, role string, text string"


def test_the_query_returns_conversations_in_reply_order(spark, tmp_path):
    rows = [(1, 1, "a", "first"), (1, 2, "b", "> first\nsecond"), (1, 3, "a", "new topic"), (1, 4, "b", "> second\nfourth"), (1, 5, "c", "> first\nfifth"), (1, 6, "c", "> new topic\nsixth"), (None, 1, "a", "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.turn, r.thread, r.position, r.depth, r.reply) for r in op3_quote_links(spark, str(tmp_path)).collect() if r.conv_id]
    assert got == [(1, 1, 0, 0, "first"), (2, 1, 1, 1, "second"), (4, 1, 2, 2, "fourth"), (5, 1, 3, 1, "fifth"), (3, 3, 0, 0, "new topic"), (6, 3, 1, 1, "sixth")]


def test_wrapped_passages_and_other_conversations(spark):
    rows = [(1, 1, "a", "The quick brown\nfox jumps.\n\nBye"), (1, 2, "b", "> the quick\n> brown fox\n> jumps.\nyes"), (1, 3, "b", "> The quick brown fox jumps.\nno"), (1, 4, "b", "> the quick brown fox\n> jumps.\n>\n> bye"), (2, 1, "a", "> fox jumps.\nso?"), (2, 2, "a", "> nowhere said")]
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_linked, r.n_passages, r.other_conv, r.other_turn) for r in conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 2] == (1, 0, 1, None, None) and got[1, 3] == (1, 1, 0, None, None) and got[1, 4][0] == 1 and got[1, 4][2] == 2
    assert got[2, 1] == (None, 0, 0, 1, 1) and got[2, 2] == (None, 0, 0, None, None)


@pytest.mark.parametrize("block", [3, 4096])
def test_reply_order_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(quotes, "BLOCK", block)
    rng = random.Random(5)
    parent = {(c, t): t - 1 if c == 3 else rng.randrange(max(0, t - 9), t) for c in (1, 2, 3) for t in range(1, 40) if c == 3 or rng.random() < 0.8}
    want = {}

    def walk(c, t, thread, depth, n):
        want[c, t] = (thread, n, depth)
        n += 1
        for s in sorted(s for (d, s), p in parent.items() if d == c and p == t):
            n = walk(c, s, thread, depth + 1, n)
        return n

    for c, t in {(c, p) for (c, _), p in parent.items()} - set(parent):
        walk(c, t, t, 0, 0)
    got = reply_order(spark.createDataFrame([(c, t, p) for (c, t), p in parent.items()], "conv_id long, turn long, parent long")).collect()
    assert len(got) == len(want) and {(r.conv_id, r.turn): (r.thread, r.position, r.depth) for r in got} == want
