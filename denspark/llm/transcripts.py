"""Roles of plain-text transcripts by a hidden Markov model, and canonical turns.

The states are the roles, each with a first line and a later line of a turn.  A line is
seen through a few features: what a speaker marker at its head says, whether an empty
line comes before it, how it begins and ends, how long it is.  Transitions and, feature
by feature, emissions are counted over all labelled transcripts; the most likely path
(Viterbi) gives the roles of a transcript's lines, and its turns are rendered alike.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

SMOOTHING = 0.5
# What speaker markers say.
SPEAKERS = {
    "user": "user human q question instruction prompt customer client visitor me".split(),
    "assistant": "assistant ai bot a answer response reply agent model chatbot".split(),
    "system": "system sys context setup".split(),
    "tool": "tool function observation".split(),
}
_SAYS = {word: role for role, words in SPEAKERS.items() for word in words}
_KINDS = ["", *SPEAKERS, "other"]
_MARKER = re.compile(r"\s{0,3}(?:(?P<open>\#{1,4}\s*|\*\*|\[|<\|?)?(?P<word>[A-Za-z]{1,12})(?:\s\d{1,3})?(?P<close>\|?>|\]|:?\*\*)?)(?P<colon>\s?:)?(?:\s+|$)")
WAYS = (len(_KINDS), 2, 2, 2, 4)


def marker(line: str) -> tuple[str, int]:
    """What a marker at the head of a line says ('' for none), and where the text after it begins."""
    found = _MARKER.match(line)
    if not found or not (found["colon"] or (found["open"] and found["close"]) or (found["open"] or "").startswith("#")):
        return "", 0
    role = _SAYS.get(found["word"].lower())
    if role is None and not found["colon"]:
        return "", 0
    return role or "other", found.end()


def features(lines: list[str]) -> np.ndarray:
    out, empty = np.zeros((len(lines), len(WAYS)), np.int64), True
    for i, line in enumerate(lines):
        says, at = marker(line)
        text = line[at:].strip()
        size = len(text)
        out[i] = (_KINDS.index(says), empty, text.endswith("?"), text[:1].isupper(), 0 if size < 20 else 1 if size < 80 else 2 if size < 240 else 3)
        empty = not line.strip()
    return out


class RoleModel:
    def __init__(self, roles: list[str], counts: Counter):
        self.roles, n = roles, 2 * len(roles)
        step = np.full((n + 1, n), SMOOTHING)
        seen = [np.full((n, w), SMOOTHING) for w in WAYS]
        for (kind, a, b), times in counts.items():
            if kind < 0:
                step[a, b] += times
            else:
                seen[kind][a, b] += times
        later = np.arange(len(roles)) * 2 + 1
        step[:, later] = np.where(np.isin(np.arange(n + 1)[:, None], np.stack([later - 1, later])) & (np.arange(n + 1)[:, None] // 2 == later[None, :] // 2), step[:, later], 0)
        with np.errstate(divide="ignore"):
            self.step = np.log(step / step.sum(axis=1, keepdims=True))
        self.seen = [np.log(x / x.sum(axis=1, keepdims=True)) for x in seen]

    def path(self, lines: list[str]) -> list[int]:
        """Most likely states; ties go to the lower state."""
        if not lines:
            return []
        given = features(lines)
        level = sum(table[:, given[:, i]] for i, table in enumerate(self.seen)).T
        best, back = self.step[-1] + level[0], []
        for x in level[1:]:
            ways = best[:, None] + self.step[:-1]
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + x
        at = [int(best.argmax())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return at[::-1]

    def turns(self, text: str) -> list[tuple[str, str]]:
        lines = text.split("\n")
        out: list[tuple[str, list[str]]] = []
        for line, state in zip(lines, self.path(lines), strict=True):
            if state % 2 == 0 or not out:
                out.append((self.roles[state // 2], [line[marker(line)[1] :]]))
            else:
                out[-1][1].append(line)
        return [(role, "\n".join(x).strip()) for role, x in out]


def canonical(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


# -- transcripts from tables ---------------------------------------------------------------

# Ways of writing a speaker marker, and of naming the speakers.
STYLES = ("{}: ", "### {}:\n", "[{}] ", "**{}:** ", "<|{}|>\n")
NAMES = ({"user": "User", "assistant": "Assistant", "system": "System"}, {"user": "Human", "assistant": "AI", "system": "System"}, {"user": "Q", "assistant": "A", "system": "Context"})


def transcript(turns: Column, key: Column) -> Column:
    """Plain text of an array of (turn, role, text), in a style that depends on the key's hash; roles it doesn't know are named as they are."""

    def written(style: str, names: dict[str, str]) -> Column:
        def one(x: Column) -> Column:
            role = F.coalesce(x["role"], F.lit("unknown"))
            name = role
            for known, shown in names.items():
                name = F.when(role == known, F.lit(shown)).otherwise(name)
            before, after = style.split("{}")
            return F.concat(F.lit(before), name, F.lit(after), F.coalesce(x["text"], F.lit("")))

        return F.array_join(F.transform(turns, one), "\n\n" if style.endswith("\n") else "\n")

    options = [written(s, n) for s in STYLES for n in NAMES]
    number = F.pmod(F.xxhash64(key), F.lit(len(options)))
    chosen = F.when(number == 0, options[0])  # only the branch that is taken is evaluated
    for i, option in enumerate(options[1:], 1):
        chosen = chosen.when(number == i, option)
    return chosen


def _labelled_lines(roles: list[str]):
    """Counts of transitions (kind -1) and of features by state, from transcripts with their turns."""
    number = {r: i for i, r in enumerate(roles)}

    def apply(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, turns in zip(batch.column("transcript").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                states = _states(lines, [(number.get(t["role"] or "unknown", len(roles) - 1), t["text"] or "") for t in turns])
                if states is None:
                    continue
                before = 2 * len(roles)
                for state, given in zip(states, features(lines).tolist(), strict=True):
                    counts[-1, before, state] += 1
                    for i, value in enumerate(given):
                        counts[i, state, value] += 1
                    before = state
        if counts:
            kind, a, b = (pa.array(x, pa.int32()) for x in zip(*counts, strict=True))
            yield pa.RecordBatch.from_arrays([kind, a, b, pa.array(list(counts.values()), pa.int64())], ["kind", "a", "b", "n"])

    return apply


def _states(lines: list[str], turns: list[tuple[int, str]]) -> list[int] | None:
    """The state of each line, by laying the turns' own lines over the transcript."""
    out, at = [], 0
    for role, text in turns:
        own = text.split("\n")
        start = at
        while at < len(lines) and not (lines[at].endswith(own[0]) and (at > start or marker(lines[at])[1] or own[0] == lines[at])):
            at += 1
        if at == len(lines):
            return None
        for i in range(start, at):  # a marker's own line, or an empty line between turns
            if marker(lines[i])[1]:
                out.append(2 * role)
            else:
                out.append(out[-1] if out and out[-1] % 2 else out[-1] + 1 if out else 2 * role)
        out.append(2 * role + (1 if at > start and out and out[-1] == 2 * role else 0))
        for _ in own[1:]:
            out.append(2 * role + 1)
        at += len(own)
    return out if len(out) == len(lines) else None


def _parsed(model: RoleModel):
    def apply(batches):
        for batch in batches:
            turns = [model.turns(x) if x else [] for x in batch.column("transcript").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([[r for r, _ in x] for x in turns], pa.list_(pa.string())), pa.array([[t for _, t in x] for x in turns], pa.list_(pa.string())), pa.array([canonical(x) for x in turns], pa.string())],
                ["row", "roles", "texts", "rendered"],
            )

    return apply


def train_roles(labelled: DataFrame) -> RoleModel:
    """Learn from rows with ``transcript`` and ``turns``, an array of (turn, role, text)."""
    turns = labelled.select(F.explode("turns").alias("t")).select(F.coalesce("t.role", F.lit("unknown")).alias("role"))
    roles = [r["role"] for r in turns.groupBy("role").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role").collect()] or ["unknown"]
    found = labelled.select("transcript", "turns").mapInArrow(_labelled_lines(roles), "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return RoleModel(roles, Counter({(r["kind"], r["a"], r["b"]): r["n"] for r in found.collect()}))  # a few hundred rows


def parse_transcripts(transcripts: DataFrame, model: RoleModel, text_col: str = "transcript") -> DataFrame:
    """Recover the turns of plain-text transcripts.

    Returns ``row`` (the columns but for the transcript), ``roles`` and ``texts`` of the
    turns and ``rendered``, all turns in one canonical form.

    * null or empty transcript: no turns, an empty rendering;
    * lines before the first marker belong to the most likely role; ties go to the more frequent role;
    * very long transcripts: whole, one at a time in a task;
    * other columns keep their names inside ``row``, so none can clash;
    * repeated rows give repeated results; an empty table gives an empty table.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in transcripts.columns if c != text_col])
    given = transcripts.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("transcript"))
    out = StructType().add("row", given.schema["row"].dataType).add("roles", ArrayType(StringType())).add("texts", ArrayType(StringType())).add("rendered", StringType())
    return given.mapInArrow(_parsed(model), out)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, transcript): the turns of each conversation in order, and their plain text.

    Ties of turn are ordered by role and text; repeated rows are turns of their own; each row
    without a conv_id is a conversation of its own, equal ones together.  Null roles are
    "unknown", null texts empty; a very long conversation is one row; other columns are left out.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    grouped = rows.groupBy("conv_id", alone.alias("alone")).agg(turns).drop("alone")
    return grouped.withColumn("transcript", transcript(F.col("turns"), F.col("conv_id")))
