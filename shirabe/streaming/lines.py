"""The line parsers over a stream: files whose lines come in any number of batches, and in any order.

lines(doc_id, line_no from 0, line, last) carry their detections, made by Column expressions as in the batch parsers; a
stateful processor keeps of every file its open record, the text lines that record has so far, and lines that came before
their turn. A record leaves when the next one opens or the file ends, and with the file's last line its state goes.
Sessions need the RocksDB state store (`use_state_store`).

Defined results: the same records as the batch parsers give for whole files; a line that comes twice counts once (after its file has ended it opens the file anew); a file
whose last line has not come keeps its open record and its state; null lines are empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import hierarchy, segment

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _plain(v):  # noqa: ANN001, ANN202
    """A value as Spark had it; pandas makes floats of whole numbers beside nulls."""
    return (None if v != v else int(v)) if isinstance(v, float) else v


class LineProcessor(StatefulProcessor):
    """Puts a file's lines in order and hands them to `step`, which changes the open record and gives those that are done.

    A record is a dict of plain values beside `parts`, its text lines, which are only appended to."""

    #: Fields of the open record and of the file that the state keeps, with their types.
    fields: dict[str, str] = {}
    #: Fields of a line that came early.
    columns: list[str] = []
    kinds: str = ""

    def __init__(self) -> None:
        head = ", ".join(["turn long", *(f"{k} {v}" for k, v in self.fields.items())])
        # parsed here, where there is a session
        self.schemas = [StructType.fromDDL(s) for s in (head, "line string", "line_no long", self.kinds)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        head, part, line_no, line = self.schemas
        self.head = handle.getValueState("head", head)
        self.parts = handle.getListState("parts", part)
        self.early = handle.getMapState("early", line_no, line)

    def start(self) -> dict:
        """The state of a file of which nothing has come."""
        raise NotImplementedError

    def step(self, now: dict, line: dict, parts: list[str]) -> dict | None:
        """Take a line; gives the record that it closes, if any, and sets `opened` where it begins one."""
        raise NotImplementedError

    def closed(self, now: dict, parts: list[str]) -> dict | None:
        """The open record at the file's end."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        names = ["turn", *self.fields]
        now = dict(zip(names, self.head.get(), strict=True)) if self.head.exists() else {"turn": 0, **self.start()}
        came: dict[int, dict] = {}
        for pdf in rows:
            for line_no, *values in zip(*(pdf[c].tolist() for c in ("line_no", *self.columns)), strict=True):
                if line_no >= now["turn"]:
                    came.setdefault(line_no, {c: _plain(v) for c, v in zip(self.columns, values, strict=True)})
        stored: list[str] | None = None  # the parts that the state has; read only if the record they belong to closes
        fresh: list[str] = []
        out, ended = [], False

        def whole() -> list[str]:
            nonlocal stored
            if stored is None:
                stored = [r[0] for r in self.parts.get()] if self.parts.exists() else []
            return stored + fresh

        while not ended:
            line = came.pop(now["turn"], None)
            if line is None:
                if not self.early.containsKey((now["turn"],)):
                    break
                line = dict(zip(self.columns, self.early.getValue((now["turn"],)), strict=True))
                self.early.removeKey((now["turn"],))
            now["turn"] += 1
            done = self.step(now, line, fresh)
            if done is not None:
                out.append({**done, "parts": whole()})
            if now.pop("opened", False):
                fresh, stored = [], []
            ended = bool(line["last"])
        if ended:
            done = self.closed(now, fresh)
            if done is not None:
                out.append({**done, "parts": whole()})
            for state in (self.head, self.parts, self.early):
                state.clear()
        else:
            if stored is not None:  # the stored parts belong to a record that is closed
                self.parts.put([(x,) for x in fresh]) if fresh else self.parts.clear()
            elif fresh:
                self.parts.appendList([(x,) for x in fresh])
            for line_no, line in came.items():
                self.early.updateValue((line_no,), tuple(line[c] for c in self.columns))
            self.head.update(tuple(now[k] for k in names))
        if out:
            yield pd.DataFrame([{"doc_id": key[0], **r} for r in out])


class FallbackProcessor(LineProcessor):
    """A number opens a record; then its first answer, explanations, or text."""

    fields = {"seq": "int", "number": "int", "text": "string", "pattern": "string", "at": "long", "answer": "string", "e": "string", "n_e": "int"}
    columns = ["line", "number", "text", "pattern", "a", "e", "ignorable", "last"]
    kinds = "line string, number int, text string, pattern string, a string, e string, ignorable boolean, last boolean"

    def start(self) -> dict:
        return {"seq": 0, "number": None, "text": None, "pattern": None, "at": 0, "answer": None, "e": None, "n_e": 0}

    def step(self, now: dict, line: dict, parts: list[str]) -> dict | None:
        if line["number"] is not None:
            done = self.closed(now, parts)
            now.update(self.start(), seq=now["seq"] + 1, number=int(line["number"]), text=line["text"], pattern=line["pattern"], at=now["turn"] - 1, opened=True)
            return done
        if not now["seq"]:
            return None
        if line["a"] is not None and now["answer"] is None:
            now["answer"] = line["a"]
        elif line["e"] is not None:
            now.update(e=line["e"], n_e=now["n_e"] + 1)
        elif not line["ignorable"]:
            parts.append(line["line"])
        return None

    def closed(self, now: dict, parts: list[str]) -> dict | None:
        return {k: now[k] for k in self.fields} if now["seq"] else None


class HierarchyProcessor(LineProcessor):
    """Headings fill levels; a question opens a record; then its first year, its first answer, an explanation, or text.

    `taking` says whether the explanation goes on; `waits` whether an explanation without words of its own waits for a line."""

    levels = [f"v{k}" for k in range(1, hierarchy.LEVELS + 1)]
    fields = {"seq": "int", **dict.fromkeys(levels, "string"), **{f"q{v}": "string" for v in levels}, "number": "string", "text": "string", "year": "string", "answer": "string", "explained": "array<string>", "taking": "boolean", "waits": "boolean"}
    columns = ["line", "level", "value", "number", "text", "a0", "y0", "ignorable", "t", "says", "own", "last"]
    kinds = "line string, level int, value string, number string, text string, a0 string, y0 string, ignorable boolean, t string, says boolean, own string, last boolean"

    def start(self) -> dict:
        return {"seq": 0, **dict.fromkeys(self.levels, ""), **self._record()}

    def _record(self) -> dict:
        return {**{f"q{v}": "" for v in self.levels}, "number": None, "text": None, "year": None, "answer": None, "explained": None, "taking": False, "waits": False}

    def step(self, now: dict, line: dict, parts: list[str]) -> dict | None:
        if line["line"] == "" or line["number"] is not None or line["a0"] is not None:
            now.update(taking=False, waits=False)
        elif line["t"] is not None and now["waits"]:
            now.update(explained=[line["t"]], taking=True, waits=False)
        elif line["t"] is not None and now["taking"]:
            now["explained"] = [*now["explained"], line["t"]]
        if line["level"] is not None:
            k = int(line["level"]) - 1
            now.update({self.levels[k]: line["value"], **dict.fromkeys(self.levels[k + 1 :], "")})
            return None
        if line["number"] is not None and line["line"] != "":
            done = self.closed(now, parts)
            now.update(self._record(), seq=now["seq"] + 1, number=line["number"], text=line["text"], **{f"q{v}": now[v] for v in self.levels}, opened=True)
            return done
        if not now["seq"] or line["line"] == "":
            return None
        if line["y0"] is not None and now["year"] is None:
            now["year"] = line["y0"]
        elif line["a0"] is not None and now["answer"] is None:
            now["answer"] = line["a0"]
        elif not line["ignorable"]:
            if not line["says"]:
                parts.append(line["line"])
            elif line["own"] is not None:
                now.update(explained=[line["own"]], taking=True, waits=False)
            else:
                now["waits"] = True
        return None

    def closed(self, now: dict, parts: list[str]) -> dict | None:
        return {k: now[k] for k in ("seq", *(f"q{v}" for v in self.levels), "number", "text", "year", "answer", "explained")} if now["seq"] else None


def _records(rows: DataFrame, processor: LineProcessor, schema: str, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    kind = dict(rows.dtypes)["doc_id"]
    return finish(rows.groupBy("doc_id").transformWithStateInPandas(processor, f"doc_id {kind}, {schema}", "append", "none"))


def stream_fallback(lines: DataFrame, min_confidence: float = 0) -> DataFrame:
    """P1 over a stream of lines: the raw records of `segment.fallback_questions`."""
    line = F.coalesce("line", F.lit(""))
    rows = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), line.alias("line"), *segment.line_kinds(line), F.coalesce("last", F.lit(False)).alias("last"))
    rows = rows.select("doc_id", "line_no", "line", "q.number", "q.text", "q.pattern", "a", "e", "ignorable", "last")
    schema = "seq int, number int, text string, pattern string, at long, answer string, e string, n_e int, parts array<string>"
    q = F.struct("number", "text", "pattern", F.col("at").alias("line_index"))
    return _records(rows, FallbackProcessor(), schema, lambda made: segment.finished(made.select("doc_id", F.col("seq").alias("id"), q.alias("q"), "answer", "e", "n_e", "parts"), min_confidence))


def stream_hierarchy(lines: DataFrame) -> DataFrame:
    """P2 over a stream of lines, blank ones included: the records of `hierarchy.parse_lines`."""
    rows = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.trim(F.coalesce("line", F.lit(""))).alias("line"), F.coalesce("last", F.lit(False)).alias("last"))
    rows = rows.select("*", *(v.alias(k) for k, v in hierarchy.line_kinds(F.col("line")).items()))
    rows = rows.select("doc_id", "line_no", "line", "h.level", "h.value", "q0.number", "q0.text", "a0", "y0", "ignorable", "t", "says", "own", "last")
    own = HierarchyProcessor()
    schema = "seq int, " + ", ".join(f"q{v} string" for v in own.levels) + ", number string, text string, year string, answer string, explained array<string>, parts array<string>"
    q = F.struct("number", "text", *(F.col(f"q{v}").alias(v) for v in own.levels))
    return _records(rows, own, schema, lambda made: hierarchy.finished(made.select("doc_id", "seq", q.alias("q"), "year", "answer", "explained", "parts")))
