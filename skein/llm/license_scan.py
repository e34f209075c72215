"""Licence scans: Aho-Corasick over words finds notice phrases and identifier tags; a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.shared import ready, table
from skein.llm.textvec import ALNUM, LOWER, rows_of

#: Fixed phrases and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases of this method's own.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license version 2": "mpl-2.0",
    "eclipse public license": "epl", "bsd 2 clause license": "bsd-2-clause", "bsd 3 clause license": "bsd-3-clause", "isc license": "isc",
    "cc by sa": "cc-by-sa", "cc by 4 0": "cc-by-4.0", "cc0 1 0 universal": "cc0-1.0", "creative commons attribution": "cc-by",
    "boost software license": "bsl-1.0", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: How sure a kind of evidence is: a tag with a sound expression, a base phrase, another phrase, a tag with an unsound one.
SURE = {"tag": 1.0, "base": 0.9, "notice": 0.8, "odd": 0.5}
_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"\(|\)|[A-Za-z0-9][A-Za-z0-9.:+-]*")
_TAG = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_RUN = re.compile(rb"[^ ]+")
_WORDS = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 32 for b in range(256))
_automata: dict = {}


def automaton(phrases: dict[str, tuple]):
    """Phrases as runs of whole words: with a space at either end, in text whose words have one space between them."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        found.add_word(f" {phrase} ", (phrase.count(" ") + 1, len(phrase) + 2, *value))
    found.make_automaton()
    return found


#: Licences that ask for no more than a notice.
PERMISSIVE = {"mit", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "apache-2.0", "bsl-1.0", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"}


def parse(expression: bytes) -> tuple[bool, list[tuple[list[str], bool, str]]]:
    """Whether a licence expression is sound, and of each part left its identifiers, whether permissive licences alone meet it, and its normal form.

    Shunting-yard: `with` binds tightest, then `and`, then `or`; parentheses group. An `or` is met where either side is, an
    `and` where both are, a licence with an exception where the licence is. Reading stops at the first
    token that can't follow, as tags stand in comments; what was read till then counts if it is complete.
    """
    values: list[tuple[list[str], bool, str]] = []
    ops: list[str] = []
    sound, need, end = True, True, 0

    def apply() -> None:
        op, b, a = ops.pop(), values.pop(), values.pop()
        if op == "with":
            name = f"{a[0][0]} with {b[0][0]}"
            values.append(([name], a[1], name))
        else:
            values.append((a[0] + b[0], (a[1] or b[1]) if op == "or" else (a[1] and b[1]), f"({a[2]} {op} {b[2]})"))

    for m in _TOKEN.finditer(expression):
        t = m[0].decode("ascii").lower()
        if expression[end : m.start()].strip(b" \t"):
            break
        if t == "(" and need:
            ops.append(t)
        elif t == ")" and not need and "(" in ops:
            while ops[-1] != "(":
                apply()
            ops.pop()
        elif t in _RANK and not need:
            if t == "with" and len(values[-1][0]) > 1:
                sound = False
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                apply()
            ops.append(t)
            need = True
        elif need and t not in _RANK and t not in "()":
            values.append(([t], t.removesuffix("-or-later").removesuffix("-only").removesuffix("+") in PERMISSIVE, t))
            need = False
        else:
            break
        end = m.end()
    if need and ops and values:
        ops.pop()
        sound = False
    while ops:
        if ops[-1] == "(":
            ops.pop()
            sound = False
        elif len(values) < 2:
            ops.pop()
            sound = False
        else:
            apply()
    return sound and len(values) == 1, values


def evaluate(expression: bytes) -> tuple[bool, set[str]]:
    """Whether a licence expression is sound, and its identifiers, an exception joined to its licence."""
    sound, values = parse(expression)
    return sound, {x for ids, _, _ in values for x in ids}


def scan(text: bytes) -> tuple:
    """Words, base places, first and last base word, base labels, labels, score, whether permissive licences meet all sound tags (None without one), the tags' normal forms, and places (word, label, kind) of a text."""
    if not _automata:
        phrases = {p: (label, "base") for p, label in BASE.items()} | {p: (label, "notice") for p, label in NOTICES.items()} | {TAG: ("", "tag")}
        _automata[0] = automaton(phrases)
    plain = text.translate(_WORDS)
    words = plain.split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    at, word, places, score = 0, 0, [], 0.0
    starts, base, labels, tags = [], set(), set(), []
    for end, (n, size, label, kind) in _automata[0].iter(line):
        word += line.count(" ", at, end + 1)
        at = end + 1
        start = word - 1 - n
        if kind == "tag":
            tags.append(start)
            continue
        if kind == "base":
            starts.append(start)
            base.add(label)
        labels.add(label)
        places.append((start, label, kind))
        score = max(score, SURE[kind])
    permissive, forms = None, []
    if tags:
        spans = [m.span() for m in _RUN.finditer(plain)]
        for start in tags:
            tag = _TAG.match(text, spans[start][0])
            if not tag:
                continue
            sound, values = parse(tag[1])
            ids = {x for v in values for x in v[0]}
            labels |= ids
            kind = "tag" if sound else "odd"
            places += [(start, x, kind) for x in sorted(ids)]
            score = max(score, SURE[kind] if ids else 0.0)
            if sound:
                permissive = values[0][1] and permissive is not False
                forms.append(values[0][2])
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, permissive, forms, places


def _scan(batches):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string())]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive", "tags"]
    for batch, data, at in rows_of(batches, "text"):
        rows = [scan(data[i:j].tobytes())[:9] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *names])


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): words, places and labels of licence phrases and identifier tags, how sure they are, and what the tags' expressions come to.

    permissive is whether licences that ask for a notice at most meet every sound tag, null without one; tags are their normal forms.

    One pass without a shuffle; memory is bounded by one text. Null and empty texts have no words, empty labels
    and score 0. Rows and repeated ids stay as they are; other columns are ignored.
    """
    ready(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, tags array<string>")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
