"""Transcript parsing and chat formatting.

A hidden Markov model over the roles reads each turn's speaker marker and line features (size, number
of lines, question at the end) and recovers the roles by Viterbi; turns are then rendered canonically,
without their markers. The model is counted from all turns with known roles that it may learn from, over a prior that
knows the usual markers, so raw transcripts with markers parse without any.

All conversations of a table are one long sequence, in which a new conversation forgets the state before it. The
sequence is cut into ranges of rows; every range gives the matrix of its best paths from each first to each last role,
the matrices are chained, and each range is then decoded between the roles that the chain gives it. So the roles are
those of one Viterbi pass over each whole conversation, of any length. Scores are integers, so sums do not depend on
the cuts.

Nulls and edge cases: a null text is an empty turn; a row with a null conversation is a conversation of
its own; null turns come first; repeated rows and turns with one number are decoded in the order of a hash of their
texts; ties: of equally likely role sequences one is taken; texts are read whole; an empty table gives an empty result;
stored roles are never read for the rows that are decoded; extra columns may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import Workspace, groups

ROLES = ("system", "user", "assistant")
MARKER = re.compile(
    r"^\s*(?:#+\s*|\*\*|\[|<\|(?:im_start\|>)?|<)?"
    r"(?:(?P<system>system|context)|(?P<user>user|instructions?|human|customer|client|question|prompt(?:er)?|q|student|inst)"
    r"|(?P<assistant>assistant|ai|bot|model|agent|answer|response|a|gpt|chatbot|teacher))"
    r"(?:\*\*|\]|\|>|>)?\s*(?:[:：>]|(?<=[\]|>*])|\n)\s*(?:\*\*)?",
    re.I,
)
N_SIZE, N_LINES = 12, 4


#: Sizes of the features, and where each begins in the packed counts of `Model.of`.
SIZES = (4, N_SIZE, N_LINES, 2)
SCALE, NEVER = 1 << 20, -(1 << 60)


def observe(text: str | None) -> tuple[int, int, int, int]:
    """Marker (0 none, else role + 1), size class, lines class, question at the end."""
    text = text or ""
    found = MARKER.match(text)
    role = 1 + ROLES.index(found.lastgroup) if found else 0
    body = text.rstrip()
    return role, min(N_SIZE - 1, int(2 * np.log2(1 + len(body) / 16))), min(N_LINES - 1, body.count("\n")), int(body.endswith(("?", "？")))


def render(role: str, text: str | None) -> str:
    text = text or ""
    found = MARKER.match(text)
    return f"<|{role}|>\n{text[found.end():].strip() if found else text.strip()}\n<|end|>\n"


@dataclass(frozen=True)
class Model:
    """Scores are log probabilities times SCALE, as integers."""

    start: list[int]
    step: list[list[int]]
    emit: tuple[np.ndarray, ...]  # role x value, of each feature

    def scores(self, seen: np.ndarray) -> list[list[int]]:
        return sum(table[:, seen[:, i]].T for i, table in enumerate(self.emit)).tolist()

    def best(self, scores: list[list[int]], new: list[bool], first: int | None, back: bool = True) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Scores of the best paths to each last role, and the roles before; `first` fixes the first role.

        Where `new` says so a conversation begins, and for the first row where `first` is None.
        """
        ways = tuple(zip(*self.step))  # ways[j][i]
        got = [self.start[j] + scores[0][j] for j in range(3)] if first is None else [scores[0][j] if j == first else NEVER for j in range(3)]
        came: list[tuple[int, int, int]] = []
        for t in range(1, len(scores)):
            a, b, c = got
            e = scores[t]
            if new[t]:
                m, at = (a, 0) if a >= b and a >= c else (b, 1) if b >= c else (c, 2)
                got = [m + self.start[j] + e[j] for j in range(3)]
                if back:
                    came.append((at, at, at))
                continue
            out, at = [], []
            for j in range(3):
                w = ways[j]
                x, y, z = a + w[0], b + w[1], c + w[2]
                m, i = (x, 0) if x >= y and x >= z else (y, 1) if y >= z else (z, 2)
                out.append(m + e[j])
                at.append(i)
            got = out
            if back:
                came.append((at[0], at[1], at[2]))
        return got, came

    def decode(self, seen: np.ndarray, new: list[bool] | None = None, first: int | None = None, last: int | None = None) -> np.ndarray:
        """The most likely roles of turns x (marker, size, lines, question), between given first and last roles."""
        got, came = self.best(self.scores(seen), new or [False] * len(seen), first)
        path = np.empty(len(seen), int)
        path[-1] = got.index(max(got)) if last is None else last
        for t in range(len(seen) - 1, 0, -1):
            path[t - 1] = came[t - 1][path[t]]
        return path


def model_of(counts: np.ndarray) -> Model:
    """A model from the counts of `count`, over prior counts."""
    start, step = np.array([1.0, 2.0, 0.2]), np.array([[0.2, 2.0, 0.4], [0.1, 0.4, 2.0], [0.1, 2.0, 0.4]])
    marker = np.full((3, 4), 0.05)
    marker[:, 0] = 2.0
    for r in range(3):
        marker[r, r + 1] = 20.0
    question = np.array([[3.0, 0.2], [2.0, 1.0], [3.0, 0.5]])
    tables, at = [], 12
    for prior, n in zip((marker, np.ones((3, N_SIZE)), np.ones((3, N_LINES)), question), SIZES):
        tables.append(prior + counts[at : at + 3 * n].reshape(3, n))
        at += 3 * n
    log = lambda x: np.round(np.log(x / x.sum(axis=-1, keepdims=True)) * SCALE).astype(np.int64)
    return Model(log(start + counts[:3]).tolist(), log(step + counts[3:12].reshape(3, 3)).tolist(), tuple(map(log, tables)))


def count(roles: np.ndarray, seen: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Counts of first roles, of steps, and of each feature by role; the first row is neither first nor a step."""
    parts = [np.bincount(roles[1:][new[1:]], minlength=3), np.bincount((roles[:-1] * 3 + roles[1:])[~new[1:]], minlength=9)]
    parts += [np.bincount(roles * n + seen[:, i], minlength=3 * n) for i, n in enumerate(SIZES)]
    return np.concatenate(parts)


def fit_turns(conversations: list[list[tuple[int, tuple[int, int, int, int]]]]) -> Model:
    """A model from conversations of (role, observation)."""
    total = np.zeros(12 + 3 * sum(SIZES), np.int64)
    for turns in conversations:
        roles, seen = np.array([r for r, _ in turns]), np.array([o for _, o in turns])
        total += count(roles, seen, np.zeros(len(turns), bool))
        total[roles[0]] += 1
    return model_of(total)


def parse_transcript(text: str | None, model: Model | None = None) -> list[tuple[str, str]]:
    """(role, content) turns of a raw transcript: markers and blank lines cut it into segments."""
    model = model or fit_turns([])
    segments: list[list[str]] = []
    blank = True
    for line in (text or "").splitlines():
        if not line.strip():
            blank = True
            continue
        if MARKER.match(line + "\n") or not segments or blank and not any(MARKER.match(s[0] + "\n") for s in segments):
            segments.append([line])
        else:
            segments[-1] += ["", line] if blank else [line]
        blank = False
    if not segments:
        return []
    texts = ["\n".join(s) for s in segments]
    path = model.decode(np.array([observe(t) for t in texts]))
    out: list[tuple[str, str]] = []
    for r, t in zip(path, texts):
        found = MARKER.match(t)
        body = t[found.end() :].strip() if found else t.strip()
        if out and out[-1][0] == ROLES[r] and not found:
            out[-1] = (ROLES[r], out[-1][1] + "\n\n" + body)
        else:
            out.append((ROLES[r], body))
    return out


def parse_transcripts(df: DataFrame, model: Model | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, turn, role, content, rendered) of the turns of raw transcripts, a text each; an empty one has no turns."""
    model = model or fit_turns([])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                turns = parse_transcript(batch.column(1)[i].as_py(), model)
                if turns:
                    roles, bodies = (list(x) for x in zip(*turns))
                    rendered = [f"<|{r}|>\n{b}\n<|end|>\n" for r, b in turns]
                    columns = [batch.column(0).take(pa.array([i] * len(turns))), pa.array(range(len(turns)), pa.int64()), *(pa.array(x, pa.string()) for x in (roles, bodies, rendered))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "turn", "role", "content", "rendered"])

    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, turn bigint, role string, content string, rendered string")
    return got.withColumnRenamed("id", id_col)


# --- whole tables --------------------------------------------------------------------------------


def _observed(batches):
    """(n, conv, turn, h, role, seen): `seen` packs the observation of each text."""
    for batch in batches:
        got = np.array([observe(t) for t in batch.column(5).to_pylist()], np.int64).reshape(-1, 4)
        packed = ((got[:, 0] * N_SIZE + got[:, 1]) * N_LINES + got[:, 2]) * 2 + got[:, 3]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(packed.astype(np.int32))], ["n", "conv", "turn", "h", "role", "seen"])


def _unpacked(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Observations, and where a conversation begins; null conversations are rows of their own."""
    x = g["seen"].to_numpy().astype(np.int64)
    seen = np.stack([x // (2 * N_LINES * N_SIZE), x // (2 * N_LINES) % N_SIZE, x // 2 % N_LINES, x % 2], axis=1)
    conv = g["conv"].combine_chunks()
    new = np.ones(len(conv), bool)
    if len(conv) > 1:
        new[1:] = pc.fill_null(pc.not_equal(conv[1:], conv[:-1]), True).to_numpy(zero_copy_only=False)
    return seen, new


def _in_order(ws: Workspace, rows: DataFrame, name: str) -> DataFrame:
    """The rows (n, conv, turn, text, role) as one sequence: `at` gives their order, `part` their range of it."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    seen = rows.select("n", "conv", "turn", F.xxhash64("text").alias("h"), "role", "text").mapInArrow(
        _observed, f"n bigint, conv {kinds['conv']}, turn {kinds['turn']}, h bigint, role int, seen int"
    )
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("h"), F.col("n")]
    at = F.monotonically_increasing_id()
    placed = seen.repartitionByRange(*order).sortWithinPartitions(*order).select("n", "conv", "role", "seen", at.alias("at"))
    return ws.write(placed.withColumn("part", F.shiftright("at", 33)), name)


def _by_part(ordered: DataFrame) -> DataFrame:
    return ordered.repartition("part").sortWithinPartitions("part", "at")


def _same(a, b) -> bool:
    return a is not None and a == b


def fit(turns: DataFrame, train: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """A model from all turns with known roles; `train` selects those that may be learnt from.

    What comes to the driver are the counts of each range of rows.
    """
    ws = Workspace(turns.sparkSession, "chat-fit")
    known = turns.where(F.col(role).isin(*ROLES) & F.col(conv).isNotNull() & train)
    code = F.array_position(F.array(*map(F.lit, ROLES)), F.col(role)).cast("int") - 1
    rows = known.select(F.monotonically_increasing_id().alias("n"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"), code.alias("role"))

    def run(batches):
        for g in groups(batches, ["part"]):
            seen, new = _unpacked(g)
            roles = g["role"].to_numpy().astype(np.int64)
            ends = [pa.array([int(roles[i])], pa.int32()) for i in (0, -1)]
            convs = [g["conv"].combine_chunks().take(pa.array([i])) for i in (0, len(roles) - 1)]
            yield pa.RecordBatch.from_arrays([g["part"].slice(0, 1).combine_chunks(), *convs, *ends, pa.array([count(roles, seen, new)], pa.list_(pa.int64()))], ["part", "c0", "c1", "r0", "r1", "counts"])

    kind = turns.schema[conv].dataType.simpleString()
    got = _by_part(_in_order(ws, rows, "ordered")).mapInArrow(run, f"part bigint, c0 {kind}, c1 {kind}, r0 int, r1 int, counts array<bigint>").orderBy("part").collect()
    total, before = np.zeros(12 + 3 * sum(SIZES), np.int64), None
    for r in got:
        total += np.array(r["counts"])
        # The first row of a range follows the last of the range before, or begins a conversation.
        total[3 + before["r1"] * 3 + r["r0"] if before and _same(before["c1"], r["c0"]) else r["r0"]] += 1
        before = r
    ws.drop("ordered")
    return model_of(total)


def chained(parts: list[dict], model: Model) -> dict[int, tuple[int, int]]:
    """First and last role of every range, from its matrix and whether it goes on with the conversation before it."""
    entry, ends = [], []
    got = None
    for p in parts:
        if got is None:
            into = list(model.start)
        elif p["goes_on"]:
            into = [max(got[i] + model.step[i][j] for i in range(3)) for j in range(3)]
        else:
            into = [max(got) + model.start[j] for j in range(3)]
        entry.append(into)
        got = [max(into[i] + p["matrix"][i][j] for i in range(3)) for j in range(3)]
        ends.append(got)
    out, last = {}, None
    for k in range(len(parts) - 1, -1, -1):
        p = parts[k]
        if last is None:
            last = ends[k].index(max(ends[k]))
        ways = [entry[k][i] + p["matrix"][i][last] for i in range(3)]
        first = ways.index(max(ways))
        out[p["part"]] = first, last
        if k:
            ways = [ends[k - 1][i] + model.step[i][first] for i in range(3)] if p["goes_on"] else ends[k - 1]
            last = ways.index(max(ways))
    return out


def format_turns(turns: DataFrame, model: Model, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, role, rendered) of every row: the recovered role and the canonical turn."""
    ws = Workspace(turns.sparkSession, "chat")
    kind = turns.schema[conv].dataType.simpleString()
    rows = ws.write(turns.select(F.monotonically_increasing_id().alias("n"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text")), "rows")
    ordered = _in_order(ws, rows.withColumn("role", F.lit(-1)), "ordered")

    def matrices(batches):
        for g in groups(batches, ["part"]):
            seen, new = _unpacked(g)
            scores, starts = model.scores(seen), new.tolist()
            m = [model.best(scores, starts, i, back=False)[0] for i in range(3)]
            convs = [g["conv"].combine_chunks().take(pa.array([i])) for i in (0, g.num_rows - 1)]
            yield pa.RecordBatch.from_arrays([g["part"].slice(0, 1).combine_chunks(), *convs, pa.array([[x for r in m for x in r]], pa.list_(pa.int64()))], ["part", "c0", "c1", "matrix"])

    got = _by_part(ordered).mapInArrow(matrices, f"part bigint, c0 {kind}, c1 {kind}, matrix array<bigint>").orderBy("part").collect()  # a row a range
    parts = [{"part": r["part"], "goes_on": k > 0 and _same(got[k - 1]["c1"], r["c0"]), "matrix": [r["matrix"][i : i + 3] for i in (0, 3, 6)]} for k, r in enumerate(got)]
    between = chained(parts, model)

    def decode(batches):
        for g in groups(batches, ["part"]):
            seen, new = _unpacked(g)
            path = model.decode(seen, new.tolist(), *between[g["part"][0].as_py()])
            yield from pa.table([g["n"], pa.array(path.astype(np.int32))], ["n", "code"]).combine_chunks().to_batches()

    roles = ws.write(_by_part(ordered).mapInArrow(decode, "n bigint, code int"), "roles")
    ws.drop("ordered")

    def show(batches):
        for batch in batches:
            names = [ROLES[c] for c in batch.column(3).to_pylist()]
            texts = [render(r, t) for r, t in zip(names, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.string()), pa.array(texts, pa.string())], ["conv", "turn", "role", "rendered"])

    joined = rows.join(roles, "n").select("conv", "turn", "text", "code")
    return joined.mapInArrow(show, f"conv {kind}, turn {turns.schema[turn].dataType.simpleString()}, role string, rendered string").withColumnsRenamed({"conv": conv, "turn": turn})
