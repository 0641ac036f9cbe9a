"""One method to a request: what a client can ask of the history, each answer a DataFrame or a small record."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import code, questions
from stratalog.functions.text import language
from stratalog.operators import chunking, graph, history, ranking, validation
from stratalog.operators.file_states import resolved_entries
from stratalog.operators.vector_search import cosine_top_k, two_rounds
from stratalog.plans.asked import error_code, retryable
from stratalog.sources.store import hashed_embedding

#: Presets of searches: limit, least score.
_BINARY = "\0binary"
PRESETS = {"query": (20, 0.65), "behavioral": (20, 0.6), "pattern": (15, 0.7)}


def relative_time(text: str, as_of: datetime) -> datetime:
    """``3h``, ``2d``, ``1w`` before ``as_of``, or an ISO time."""
    if m := re.fullmatch(r"(\d+)([hdw])", text):
        return as_of - timedelta(**{{"h": "hours", "d": "days", "w": "weeks"}[m[2]]: int(m[1])})
    return datetime.fromisoformat(text)


def parsed_tags(text: str | None) -> list[str]:
    return [t.strip() for t in (text or "").split(",") if t.strip()]


def criteria(**given) -> dict:
    """Filters from options: complexity bounds, quality, types, patterns, smells, domains; what is not given is no filter."""
    out = {k: parsed_tags(v) if isinstance(v, str) else list(v) for k, v in given.items() if k in ("types", "patterns", "smells", "domains") and v}
    if given.get("min_complexity") is not None or given.get("max_complexity") is not None:
        out["complexity"] = (given.get("min_complexity") or 0, given.get("max_complexity") or 100)
    if given.get("quality") is not None:
        out["quality"] = float(given["quality"])
    return out


class Filters:
    """Filters of the list of snapshots, as a client sets, clears and flips them: any_tags, all_tags, since, until,
    favorite, pattern."""

    NAMES = ("any_tags", "all_tags", "since", "until", "favorite", "pattern")

    def __init__(self, **given) -> None:
        self.given: dict = {}
        for k, v in given.items():
            self.set(k, v)

    def set(self, name: str, value) -> Filters:
        """None, an empty list and an empty text are no filter."""
        if name not in self.NAMES:
            raise KeyError(name)
        if value is None or value == [] or value == "":
            self.given.pop(name, None)
        else:
            self.given[name] = value
        return self

    def clear(self, name: str | None = None) -> Filters:
        self.given = {} if name is None else {k: v for k, v in self.given.items() if k != name}
        return self

    def toggle_favorite(self) -> Filters:
        return self.set("favorite", None if self.given.get("favorite") else True)

    def count(self) -> int:
        """Filters that hold; two bounds of time are one."""
        return len(set(self.given) - {"since", "until"}) + bool({"since", "until"} & set(self.given))

    def description(self) -> str:
        g, out = self.given, []
        if "since" in g or "until" in g:
            out.append(f"{g.get('since', '')} to {g.get('until', '')}".strip())
        out += [f"{k.replace('_', ' ')}: {', '.join(g[k])}" for k in ("any_tags", "all_tags") if k in g]
        if "favorite" in g:
            out.append("favorites" if g["favorite"] else "no favorites")
        if "pattern" in g:
            out.append(f"files: {g['pattern']}")
        return "; ".join(out)


def retried(work: Callable[[], object], attempts: int = 3, pause: float = 1.0) -> object:
    """Run ``work``, again after 1, 2, 4.. pauses where its error says it may help; an answer with success=False fails."""
    for n in range(attempts):
        try:
            answer = work()
            if isinstance(answer, dict) and answer.get("success") is False:
                raise RuntimeError(str(answer.get("error", "failed")))
            return answer
        except Exception as e:
            low = str(e).lower()
            never = any(w in low for w in ("not found", "permission", "invalid", "malformed")) and not any(w in low for w in ("timeout", "network"))
            if never or n == attempts - 1:
                raise
            time.sleep(pause * 2**n)
    return None


class Service:
    """Requests over snapshots (snapshot_id, workspace, ts, ..), files (entries) and vectors (chunk_id, embedding)."""

    def __init__(self, spark: SparkSession, snapshots: DataFrame, files: DataFrame, chunks: DataFrame | None = None, vectors: DataFrame | None = None) -> None:
        self.spark, self._snapshots, self._files, self._chunks, self._vectors = spark, snapshots, files, chunks, vectors
        self.cat, self.entries = history.catalogue(snapshots), history.entries_of(files)

    # history
    def get_status(self) -> dict:
        return {"snapshots": self.cat.count(), "indexed": self._vectors is not None}

    def get_snapshots(self, offset: int = 0, limit: int = 0, **filters) -> DataFrame:
        return history.page(history.listed(self.cat, entries=self.entries, **filters), list(history.ORDER), offset, limit)

    def get_snapshot(self, snapshot_id: str) -> DataFrame:
        return self.cat.filter(F.col("snapshot_id") == snapshot_id)

    def delete_snapshot(self, snapshot_id: str) -> Service:
        keep = F.col("snapshot_id") != snapshot_id
        return Service(self.spark, self._snapshots.filter(keep), self._files.filter(keep), self._chunks, self._vectors)

    def navigate_snapshot(self, snapshot_id: str, forward: bool = True) -> DataFrame:
        return history.neighbours(self.cat).filter(F.col("snapshot_id") == snapshot_id).select(F.col("next_id" if forward else "previous_id").alias("snapshot_id"))

    def get_snapshot_file_content(self, snapshot_id: str, path: str) -> DataFrame:
        return self.contents().filter((F.col("snapshot_id") == snapshot_id) & (F.col("path") == path))

    def contents(self) -> DataFrame:
        return resolved_entries(self._snapshots, self._files)

    def get_snapshot_changes(self, snapshot_id: str) -> DataFrame:
        return self.entries.filter((F.col("snapshot_id") == snapshot_id) & (F.col("marker") != "same")).select("path", "marker")

    def compare_snapshots(self, first: str, second: str, live_only: bool = True) -> DataFrame:
        """(path, change) from the first to the second."""
        texts = self.contents().select("snapshot_id", "path", F.xxhash64(F.coalesce("content", F.lit("\0"))).alias("h"))
        live = self.entries.filter("marker <> 'deleted'") if live_only else self.entries
        state = live.join(texts, ["snapshot_id", "path"], "left").select("snapshot_id", "path", "h")
        return history.classify(state.filter(F.col("snapshot_id") == second), state.filter(F.col("snapshot_id") == first), ["path"], "h")

    def restore_snapshot(self, snapshot_id: str, workspace_files: DataFrame, paths: Iterable[str] | None = None) -> DataFrame:
        """The actions (path, action, content) that make ``workspace_files`` (path, content) what the snapshot held;
        only of ``paths`` if given. Binary files are left alone."""
        target = self.contents().filter(F.col("snapshot_id") == snapshot_id).select("path", "content")
        binary = self.entries.filter((F.col("snapshot_id") == snapshot_id) & (F.col("marker") == "binary")).select("path")
        plan = history.classify(target, workspace_files.join(binary, "path", "left_anti"), ["path"], "content").filter("change <> 'U'")
        if paths is not None:
            plan = plan.filter(F.col("path").isin(list(paths)))
        action = F.when(F.col("change") == "D", "delete").when(F.col("change") == "A", "write").otherwise("overwrite")
        return plan.join(target, "path", "left").select("path", action.alias("action"), "content")

    def take_snapshot(self, current: DataFrame, base: str, selected: Iterable[str] | None = None, automatic: bool = False) -> DataFrame:
        """(path, change, content) of files (path, content, is_binary) against a base: only of ``selected`` if given,
        which then bounds what can be gone, too. A binary file has no content; one that was a text, or turns into one,
        has changed. An automatic snapshot that would hold no change is none: it has no rows."""
        entry = F.col("snapshot_id") == base
        binary = self.entries.filter(entry & (F.col("marker") == "binary")).select("path", F.lit(_BINARY).alias("state"))
        before = self.contents().filter(entry).select("path", F.col("content").alias("state")).unionByName(binary)
        own = current.select("path", F.when(~F.coalesce("is_binary", F.lit(False)), F.col("content")).alias("content"), F.when(F.coalesce("is_binary", F.lit(False)), _BINARY).otherwise(F.col("content")).alias("state"))
        if selected is not None:
            chosen = F.col("path").isin(list(selected))
            before, own = before.filter(chosen), own.filter(chosen)
        found = history.classify(own, before, ["path"], "state")
        if automatic and found.filter("change <> 'U'").isEmpty():
            found = found.limit(0)
        return found.join(own.select("path", "content"), "path", "left")

    def get_workspace_info(self) -> DataFrame:
        return self.cat.groupBy("workspace").agg(F.count("*").alias("snapshots"), F.max("ts").alias("last_ts"))

    def get_current_state(self) -> DataFrame:
        last = history.retained(self.cat, 1).select("snapshot_id", "workspace")
        return self.entries.filter("marker <> 'deleted'").join(last, "snapshot_id").groupBy("workspace", language("path").alias("lang")).agg(F.count("*").alias("files"))

    def validate_snapshot(self, snapshot_id: str) -> DataFrame:
        """Entries of a snapshot whose text can't be had."""
        return self.contents().filter((F.col("snapshot_id") == snapshot_id) & F.col("content").isNull()).select("path")

    def export_snapshot(self, snapshot_id: str) -> DataFrame:
        own = self.entries.filter(F.col("snapshot_id") == snapshot_id)
        return own.select(F.to_json(F.struct(*sorted(own.columns))).alias("value"))

    # search
    def search_snapshots(self, text: str, preset: str = "query", limit: int | None = None, least: float | None = None) -> DataFrame:
        return self.enhanced_search(text, limit or PRESETS[preset][0], PRESETS[preset][1] if least is None else least)

    def enhanced_search(self, text: str, limit: int = 20, least: float = 0.65, filters: dict | None = None) -> DataFrame:
        """Chunks nearest to a question, spread over files; with ``filters`` (see ``criteria``) only those that pass them."""
        return self._searched([text], limit, least, filters).drop("text")

    def _searched(self, texts: list[str], limit: int = 20, least: float = 0.65, filters: dict | None = None) -> DataFrame:
        """The answers to all questions by one pass over the vectors."""
        asked = self.spark.createDataFrame(list(enumerate(texts)), "vec_id long, text string").withColumn("embedding", hashed_embedding(F.col("text")))
        ids = self._vectors.select(F.xxhash64("chunk_id").alias("vec_id"), "chunk_id", "embedding")
        own = self._chunks
        if filters:
            own = self._passing(filters)
            ids = ids.join(own.select("chunk_id"), "chunk_id", "left_semi")
        near = cosine_top_k(ids, asked, min(100, 3 * limit), least).join(ids.select("vec_id", "chunk_id"), "vec_id").drop("place")
        both = near.join(own.select("chunk_id", "snapshot_id", "path", "start_line", "end_line", "content"), "chunk_id")
        found = two_rounds(both, ["query"], ["snapshot_id", "path"], "score", ["vec_id"], limit)
        return found.join(asked.select(F.col("vec_id").alias("query"), "text"), "query")

    def _passing(self, filters: dict) -> DataFrame:
        """Chunks that pass the filters, judged by their whole text."""
        c = self._chunks.withColumns({
            "score": F.lit(1.0), "file_path": F.col("path"), "readability": code.readability("content") / 100, "cyclomatic": code.cyclomatic("content", "lang"), "kind": code.semantic_type("content", "lang"),
            "patterns": code.design_patterns("content"), "smells": code.code_smells("content"),
        })
        return ranking.selected(c, 0.0, filters.get("quality"), filters.get("complexity"), filters.get("types"), filters.get("patterns"), filters.get("smells"), layers=filters.get("layers"), include=filters.get("include"), exclude=filters.get("exclude"))

    def process_query(self, text: str) -> dict:
        row = self.spark.createDataFrame([(text,)], "q string").select(questions.intent("q").alias("intent"), questions.complexity("q").alias("complexity"), questions.issues("q").alias("issues"), questions.parts("q").alias("parts"), questions.added_terms("q", questions.intent("q")).alias("terms")).first()
        return row.asDict()

    def batch_search(self, texts: Iterable[str], **options) -> DataFrame:
        """Answers to several questions, equal ones asked once; ``text`` names the question."""
        return self._searched(list(dict.fromkeys(texts)), **options)

    def index_snapshots(self, ids: Iterable[str] | None = None) -> DataFrame:
        """Vectors of the chunks not indexed yet."""
        todo = self._chunks if ids is None else self._chunks.filter(F.col("snapshot_id").isin(list(ids)))
        if self._vectors is not None:
            todo = todo.join(self._vectors.select("chunk_id"), "chunk_id", "left_anti")
        return todo.select("chunk_id", "snapshot_id", hashed_embedding(F.col("content")).alias("embedding"))

    # analysis
    def analyze_chunk(self, chunk_id: str | None = None) -> DataFrame:
        c = self._chunks if chunk_id is None else self._chunks.filter(F.col("chunk_id") == chunk_id)
        return c.select("chunk_id", code.semantic_type("content", "lang").alias("kind"), code.complexity("content", "lang").alias("complexity"), code.maintainability("content").alias("maintainability"), code.design_patterns("content").alias("patterns"), code.code_smells("content").alias("smells"), code.security_concerns("content").alias("concerns"), code.line_census("content").alias("lines"))

    analyze_quality = analyze_chunk

    def analyze_file(self, snapshot_id: str, path: str) -> DataFrame:
        own = self._chunks.filter((F.col("snapshot_id") == snapshot_id) & (F.col("path") == path))
        x = code.cyclomatic("content", "lang")
        return own.groupBy("snapshot_id", "path").agg(F.count("*").alias("chunks"), F.avg(x).alias("complexity"), F.avg(code.maintainability("content")).alias("maintainability"), F.array_distinct(F.flatten(F.collect_set(code.security_concerns("content")))).alias("concerns"))

    def enhanced_chunk_file(self, snapshot_id: str, path: str, strategy: str | None = None, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
        return chunking.chunked(self.get_snapshot_file_content(snapshot_id, path).withColumn("lang", language("path", "content")), strategy, size, overlap)

    def chunk_snapshot(self, snapshot_id: str, patterns: Iterable[str] = (), strategy: str | None = None) -> DataFrame:
        own = self.contents().filter(F.col("snapshot_id") == snapshot_id)
        if patterns := list(patterns):
            own = own.filter(F.exists(F.lit(patterns), lambda p: F.contains(F.col("path"), p)))
        return chunking.chunked(own.withColumn("lang", language("path", "content")), strategy)

    def list_chunks(self, page: int = 1, limit: int = 50, by: str = "start_line", descending: bool = False) -> DataFrame:
        order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
        return history.page(self._chunks, [order, "chunk_id"], (page - 1) * limit, limit)

    def get_chunk_metadata(self, chunk_id: str) -> DataFrame:
        return validation.validated(self._chunks.filter(F.col("chunk_id") == chunk_id))

    def get_chunk_context(self, chunk_id: str, radius: int = 5) -> DataFrame:
        c = self._chunks.filter(F.col("chunk_id") == chunk_id).select("chunk_id", "snapshot_id", "path", "start_line", "end_line")
        l = F.split("content", "\n")  # noqa: E741
        first = F.greatest(F.col("start_line") - radius, F.lit(0))
        return c.join(self.contents(), ["snapshot_id", "path"]).select("chunk_id", F.array_join(F.slice(l, first + 1, F.col("end_line") + radius + 1 - first), "\n").alias("context"))

    def get_chunk_dependencies(self, chunk_id: str, depth: int = graph.DEPTH) -> DataFrame:
        edges = graph.call_edges(self._chunks).unionByName(graph.inherit_edges(self._chunks))
        return graph.reach(edges, depth).filter(F.col("src") == chunk_id)

    def batch_analyze(self, operations: DataFrame, all_or_none: bool = False) -> DataFrame:
        """(id, chunk_id, status, error, code, again, kind, complexity, maintainability, patterns, smells, concerns) of
        operations (id, chunk_id) in one job: the analysis of each chunk; one that names no chunk fails alone, or,
        with ``all_or_none``, all with it: the others are skipped."""
        done = self.analyze_chunk().drop("lines").withColumn("known", F.lit(True))
        both = operations.select("id", "chunk_id").join(done, "chunk_id", "left")
        error = F.when(F.col("known").isNull(), F.concat(F.lit("chunk not found: "), F.coalesce("chunk_id", F.lit("null"))))
        status = F.when(error.isNull(), "done").otherwise("failed")
        results = ("kind", "complexity", "maintainability", "patterns", "smells", "concerns")
        out = both.select("id", "chunk_id", status.alias("status"), error.alias("error"), F.when(error.isNotNull(), error_code(error)).alias("code"), F.when(error.isNotNull(), retryable(error)).alias("again"), *results)
        if all_or_none and not out.filter("status = 'failed'").isEmpty():
            out = out.withColumn("status", F.when(F.col("status") == "done", "skipped").otherwise(F.col("status"))).withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in results})
        return out
