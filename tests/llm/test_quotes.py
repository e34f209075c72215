import random
import re

import pytest

from skein.llm import quotes
from skein.llm.quotes import conversations, link_quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract of link_quotes row by row."""

    def parse(text):
        out = set()
        for line in (text or "").split("\n"):
            marks = re.match(r"^\s*((?:>\s?)+)", line)
            passage = re.sub(r"\s+", " ", line[marks.end() if marks else 0 :].lower()).strip()
            if passage:
                out.add((marks.group(1).count(">") if marks else 0, passage))
        return out

    for conv, turn, role, text in rows:
        reply = "\n".join(x for x in (text or "").split("\n") if not re.match(r"^\s*>", x)).strip(" ")
        quoted = [q for q in parse(text) if q[0] > 0] if conv is not None and turn is not None else []
        source = [max((t for c, t, _, x in rows if c == conv and t is not None and t < turn and (0, p) in parse(x)), default=None) for _, p in quoted]
        found = [s for s in source if s is not None]
        yield (conv, turn, role, reply, len(quoted), len(found), max((q[0] for q in quoted), default=0), max(found, default=None))


def test_quotes_link_to_the_latest_earlier_turn(spark):
    rows = [(1, 1, "user", "Hello  there"), (1, 2, "assistant", "> hello there\nHi"), (1, 3, "user", ">> Hello there\n> Hi\nbye"), (1, 4, "user", "> unknown\n"), (2, 1, "user", None), (None, 1, "user", "> x"), (1, 2, "assistant", "> hello there\nHi")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in link_quotes(df).collect()), key=repr)
    assert (1, 2, "assistant", "Hi", 1, 1, 1, 1) in got and (1, 3, "user", "bye", 2, 2, 2, 2) in got and (1, 4, "user", "", 1, 0, 1, None) in got and (2, 1, "user", "", 0, 0, 0, None) in got
    assert len(got) == 7 and link_quotes(df.limit(0)).count() == 0 and [r.turn for r in conversations(df).where("conv_id = 1").collect()] == [1, 2, 2, 3, 4]


@pytest.mark.parametrize("block", [2, 4096])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(quotes, "BLOCK", block)
    rng = random.Random(3)
    said = ["one two", "One  two", "three", "four five", "", " "]
    rows = []
    for conv in (1, 2, None):
        for turn in [*range(1, 12), 5, None]:
            lines = [rng.choice(["", "", "> ", ">> ", ">", " > > >"]) + rng.choice(said) for _ in range(rng.randint(0, 4))]
            rows.append((conv, turn, rng.choice(["user", None]), "\n".join(lines) if rng.random() < 0.9 else None))
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n_quoted string")
    assert sorted((tuple(r) for r in link_quotes(df).collect()), key=repr) == sorted(brute(rows), key=repr)
