"""The serving surface: tools over a store, for programs and the command line. Each returns a DataFrame."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import on_workers
from .config import CONFLICT_SUBTYPES, CONFLICT_TYPES, SEMANTIC_RELATIONS, VALID_TYPES, Search
from .functions.extract import entities, key_data, verified
from .operators import retrieval as R
from .operators.answers import answer_verdicts, checked_answers, enforced
from .operators.graphs import expanded
from .operators.cache import ResultCache, channel_tag
from .operators.index import TextIndex
from .operators.vectors import VectorIndex

#: Tools by name, as a client lists them.
TOOLS = ("search_memories", "expand_entry", "entity_knowledge", "entity_extract", "concept_query", "ontology_explore", "hard_delete_memory")


@dataclass
class Engine:
    """A store with its side tables; those that are None are left out of a search."""

    spark: SparkSession
    store: DataFrame
    access: DataFrame | None = None
    query_vectors: DataFrame | None = None
    entry_vectors: DataFrame | VectorIndex | None = None
    edges: DataFrame | None = None
    concepts: DataFrame | None = None
    index: TextIndex | None = None
    cache: ResultCache | None = None
    now: str | None = None

    def __post_init__(self) -> None:
        on_workers(self.spark)

    def search_memories(self, texts: list[str] | DataFrame, mode: str = "auto", top_k: int = 5, track: str | None = None, types: str | None = None, **switches: bool) -> DataFrame:
        """Results of one or many query texts. The track is applied before scoring, the types after the cut.

        switches: router, gate, time, graph, contradictions. A stored index knows the tracks, and reads the lists of the asked one. With a cache, what was
        asked of this version of the index a little while ago is not searched again.
        """
        cfg = Search(top_k=top_k, **switches)
        queries = texts if isinstance(texts, DataFrame) else self.spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
        store = self.store if track is None else self.store.where(F.col("memory_track") == track)
        access = self.access if self.access is not None else self.spark.createDataFrame([], "entry_id string, scene string, accessed_at timestamp")
        vectors = self.query_vectors is not None and mode in ("auto", "dual", "embed")
        entry_vectors = self.entry_vectors.join(store.select("id"), "id", "left_semi") if vectors and track is not None and isinstance(self.entry_vectors, DataFrame) else self.entry_vectors

        def run(asked: DataFrame) -> DataFrame:
            return R.search(asked, store, access, self.query_vectors if vectors else None, entry_vectors if vectors else None, cfg, self.index, self.edges, track)

        if self.cache is not None and self.index is not None:
            now = self.now or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            out = self.cache.search(queries, run, channel_tag(cfg, mode=mode, track=track), f"{self.index.root}@{self.index.version}", now)
        else:
            out = run(queries)
        return out if types is None else out.where(F.col("type").isin(*[t.strip() for t in types.split(",")]))

    def checked_search(self, texts: list[str] | DataFrame, known_agents: tuple[str, ...] = (), enforce: bool = False, top_k: int = 5, **settings) -> DataFrame:
        """Results with the rules' action and reasons of their query; enforced, refused queries lose theirs. Settings are those of :meth:`search_memories`."""
        queries = texts if isinstance(texts, DataFrame) else self.spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
        found = self.search_memories(queries, top_k=top_k, **settings).withColumnRenamed("rank", "rank0")
        hits = found.join(self.store.select("id", "source_agent", "confidence"), "id").withColumn("evidence", F.lit(None).cast("double"))
        said = checked_answers(queries, hits, Search(top_k=top_k), known_agents)
        kept = enforced(hits, said) if enforce else hits.withColumn("low_confidence", F.lit(False))
        return kept.join(said.select("qid", "action", "reasons"), "qid").withColumnRenamed("rank0", "rank").drop("evidence")

    def verify_search(self, texts: list[str] | DataFrame, top_k: int = 5, **settings) -> DataFrame:
        """For questions with figures: which of them stand in the entries found, with the places."""
        queries = texts if isinstance(texts, DataFrame) else self.spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
        asked = queries.where(F.size(key_data("text")) > 0)
        return answer_verdicts(asked, self.search_memories(asked, top_k=top_k, **settings), self.store)

    def expand_entry(self, ids: list[str], tier: str = "expand") -> DataFrame:
        """Entries by id; ids that do not exist come back with an error."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string")
        found = asked.join(self.store, "id", "left")
        return found.withColumn("tier", F.lit(tier)).withColumn("error", F.when(F.col("summary").isNull(), "not_found"))

    def timeline(self, start: str, end: str, limit: int = 50) -> DataFrame:
        return self.store.where(F.col("timestamp").between(start, end)).orderBy(F.desc("timestamp"), "id").limit(limit)

    def entity_knowledge(self, ids: list, per_seed: int = 3) -> DataFrame:
        """The heaviest neighbours of entities or entries."""
        kind = dict(self.edges.dtypes)["id1"]
        return expanded(self.spark.createDataFrame([(i,) for i in ids], f"id {kind}"), self.edges, per_seed)

    def entity_extract(self, texts: DataFrame) -> DataFrame:
        """(id, name) of entities that the rules find in texts (id, text)."""
        return texts.select("id", F.explode(entities(F.col("text"))).alias("name"))

    def concept_query(self, term: str, top_k: int = 10) -> DataFrame:
        """Concepts (id, label, alt array) by an exact label, an exact alternative, then parts of either."""
        t = F.lit(term.lower())
        alt = F.transform("alt", lambda a: F.lower(a))
        level = F.when(F.lower("label") == t, 0).when(F.array_contains(alt, t), 1).when(F.contains(F.lower("label"), t), 2).when(F.exists(alt, lambda a: F.contains(a, t)), 3)
        return self.concepts.withColumn("level", level).where("level is not null").orderBy("level", "id").limit(top_k)

    def ontology_explore(self) -> DataFrame:
        """Names of all enumerations with their members."""
        groups = {"type": VALID_TYPES, "conflict": CONFLICT_TYPES, "conflict_subtype": CONFLICT_SUBTYPES, "relation": SEMANTIC_RELATIONS}
        return self.spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "enumeration string, member string")

    def verify(self, claims: DataFrame) -> DataFrame:
        """How many numbers, dates and amounts of claims (id, text) stand in the entries that they name."""
        keyed = claims.select("id", key_data("text").alias("keys"))
        return keyed.join(self.store.select("id", "content", "summary"), "id").select("id", verified(F.col("keys"), F.col("content"), F.col("summary")).alias("v")).select("id", "v.passed", "v.total")

    def hard_delete_memory(self, *_: object) -> DataFrame:
        """Always refuses."""
        return self.spark.createDataFrame([("refused", "reserved_not_implemented")], "status string, reason string")
