"""Knowledge graph as two tables: entities and edges.

An entity id is a digest of (tenant, kind, normalized name), so edges carry
their entity ids without any lookup.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import patterns as P
from corpusloom.functions import text as T
from corpusloom.operators import chunking
from corpusloom.operators.prepare import DOC

TQ = ["tenant_id", "query_id"]
STEP = 1000  # emit positions reserved per chunk
# Validation states of an edge.
PENDING, VALIDATED, REJECTED = "pendente_de_validacao", "validada", "rejeitada"


def _edge(
    order: Column, relation: str, source: tuple, target: tuple, span: Column, confidence: float = 1.0
) -> Column:
    def text(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        order.cast("long").alias("emit_order"),
        F.lit(relation).alias("relation"),
        F.lit(source[0]).alias("source_kind"),
        text(source[1]).alias("source_name"),
        F.lit(target[0]).alias("target_kind"),
        text(target[1]).alias("target_name"),
        span.alias("source_span"),
        F.lit(confidence).alias("confidence"),
        F.lit("dictionary").alias("extracted_by"),
    )


def norm_label() -> Column:
    return F.coalesce("regulation_number", "document_title", "filename")


def edges_from_metadata(meta: DataFrame) -> DataFrame:
    """Edges of the document's own fields."""
    # Relations, kinds and the span of the head.
    head, norm = F.lit("cabeçalho"), ("norma", norm_label())
    listed = F.array(
        _edge(F.lit(1), "identifica", ("documento", F.col("filename")), norm, head),
        _edge(F.lit(2), "emitida_por", norm, ("fonte", F.col("authority")), head),
        _edge(F.lit(3), "emitida_por", norm, ("orgao", F.col("authority")), head),
        _edge(F.lit(4), "possui_status", norm, ("vigencia", F.col("status")), head),
    )
    return (
        meta.select(*DOC, "filename", "status", F.explode(listed).alias("e"))
        .select(*DOC, "filename", "status", "e.*")
        .filter("target_name IS NOT NULL")
    )


def may_hold_topics(text: Column) -> Column:
    """Whether a text can name a topic once its lines are normalized: it holds a word of each word of some spelling."""
    low = F.replace(F.lower(text), F.lit("\u00ad"), F.lit(""))
    spellings = [a.split(" ") for _, aliases in P.TOPICS for a in aliases]
    return reduce(or_, [reduce(and_, [F.contains(low, F.lit(w)) for w in words]) for words in spellings])


def topic_hits(chunks: DataFrame) -> DataFrame:
    """Head chunks with the topics they mention, in dictionary order."""
    body = F.lower("body")
    hits = []
    for i, (_, aliases) in enumerate(P.TOPICS):
        seen = F.lit(False)
        for alias in aliases:
            seen = seen | F.contains(F.col("_low"), F.lit(alias))
        hits.append(F.when(seen, F.lit(i)))
    span = F.coalesce(chunking.item_label(), "section", "chapter", "title", F.lit("trecho"))
    return (
        chunks.withColumn("_low", body)
        .select(*DOC, "chunk", span.alias("span"), F.array_compact(F.array(*hits)).alias("topics"))
        .filter("size(topics) > 0")
    )


def _topic(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n, _ in P.TOPICS]), i + 1)


def edges_from_topics(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Three edges per (chunk, topic): subject, regulation, evidence."""
    named = hits.join(meta.select(*DOC, "filename", "status", norm_label().alias("_norm")), DOC)
    one = named.select("*", F.explode("topics").alias("i"))
    at, span, name = F.col("chunk") * STEP + F.col("i") * 3, F.col("span"), _topic(F.col("i"))
    doc = ("documento", F.col("filename"))
    label = F.concat("filename", F.lit("::"), "span")
    # Relations and kinds.
    listed = F.array(
        _edge(at, "trata_de", doc, ("tema", name), span),
        _edge(at + 1, "regula", ("norma", F.col("_norm")), ("assunto", name), span),
        _edge(at + 2, "evidencia_vem_de", ("evidencia", label), doc, span),
    )
    return one.select(*DOC, "filename", "status", F.explode(listed).alias("e")).select(
        *DOC, "filename", "status", "e.*"
    )


def topic_cooccurrence(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Concept pairs of one chunk: at most six, from a dictionary of four topics."""
    named = hits.join(meta.select(*DOC, "filename", "status"), DOC)
    pairs = F.flatten(
        F.transform(
            "topics",
            lambda a: F.transform(
                F.filter("topics", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    one = named.select("*", F.explode(pairs).alias("p"))
    at = F.col("chunk") * STEP + 500 + F.col("p.a") * 10 + F.col("p.b")
    edge = _edge(
        at,
        "relacionado_a",
        ("conceito", _topic(F.col("p.a"))),
        ("conceito", _topic(F.col("p.b"))),
        F.col("span"),
        0.6,
    )
    return one.select(*DOC, "filename", "status", edge.alias("e")).select(
        *DOC, "filename", "status", "e.*"
    )


def entity_id(kind: Column, normalized: Column) -> Column:
    return T.sha_hex(F.concat_ws("|", F.col("tenant_id"), kind, normalized))


def with_entities(edges: DataFrame) -> DataFrame:
    """Normalized names, entity ids and the edge id."""
    named = edges.withColumns(
        {
            "source_norm": T.normalize_text(F.col("source_name")),
            "target_norm": T.normalize_text(F.col("target_name")),
        }
    ).withColumns(
        {
            "source_id": entity_id(F.col("source_kind"), F.col("source_norm")),
            "target_id": entity_id(F.col("target_kind"), F.col("target_norm")),
        }
    )
    return named.withColumn(
        "edge_id",
        T.sha_hex(F.concat_ws("|", "tenant_id", "document_id", "source_id", "relation", "target_id")),
    )


def edge_dedup(edges: DataFrame) -> DataFrame:
    """First emission of an edge per document; its span survives."""
    rest = [c for c in edges.columns if c not in (*DOC, "edge_id")]
    first = F.min_by(F.struct(*rest), F.col("emit_order")).alias("e")
    return edges.groupBy(*DOC, "edge_id").agg(first).select(*DOC, "edge_id", "e.*")


def edge_status(edges: DataFrame) -> DataFrame:
    """Validated only when the validity is confirmed and the edge is certain."""
    sure = F.col("status").isin(P.STATUS_IN_FORCE, P.STATUS_REVOKED) & (F.col("confidence") >= 1.0)
    return edges.withColumn("validation_status", F.when(sure, VALIDATED).otherwise(PENDING))


def extract_edges(meta: DataFrame, hits: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """All edges of the documents, one row per edge and document.

    ``hits`` are the ``topic_hits`` of the heads; ``extra`` edges of another
    extractor, in the same columns.
    """
    edges = (
        edges_from_metadata(meta)
        .unionByName(edges_from_topics(hits, meta))
        .unionByName(topic_cooccurrence(hits, meta))
    )
    if extra is not None:
        edges = edges.unionByName(extra)
    return edge_status(edge_dedup(with_entities(edges)))


def resolve_entities(edges: DataFrame) -> DataFrame:
    """One entity per (tenant, kind, normalized name); the first spelling is kept."""
    ends = edges.select(
        "tenant_id",
        "document_id",
        "emit_order",
        F.explode(
            F.array(
                F.struct(
                    F.lit(0).alias("end"),
                    F.col("source_id").alias("entity_id"),
                    F.col("source_kind").alias("kind"),
                    F.col("source_name").alias("name"),
                    F.col("source_norm").alias("name_normalized"),
                ),
                F.struct(
                    F.lit(1).alias("end"),
                    F.col("target_id").alias("entity_id"),
                    F.col("target_kind").alias("kind"),
                    F.col("target_name").alias("name"),
                    F.col("target_norm").alias("name_normalized"),
                ),
            )
        ).alias("e"),
    ).select("tenant_id", "document_id", "emit_order", "e.*")
    return ends.groupBy("tenant_id", "entity_id", "kind", "name_normalized").agg(
        F.min_by("name", F.struct("document_id", "emit_order", "end")).alias("name")
    )


def alias_table(df: DataFrame) -> DataFrame:
    """The fixed alias list as rows (a dozen)."""
    rows = [
        (name, i, alias) for name, aliases in P.ENTITY_ALIASES.items() for i, alias in enumerate(aliases)
    ]
    return df.sparkSession.createDataFrame(rows, "name_normalized string, position int, alias string")


def expand_aliases(entities: DataFrame) -> DataFrame:
    """Alias rows of known entities, unique per tenant and alias; no self-aliases."""
    table = alias_table(entities).withColumn("alias_normalized", T.normalize_text(F.col("alias")))
    joined = entities.join(F.broadcast(table), "name_normalized").filter(
        "alias_normalized <> name_normalized"
    )
    w = Window.partitionBy("tenant_id", "alias_normalized").orderBy("entity_id", "position")
    return (
        joined.withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .select("tenant_id", "entity_id", "kind", "alias", "alias_normalized")
    )


# --------------------------------------------------------------------------- search


def question_words(questions: DataFrame) -> DataFrame:
    """Distinct normalized words of at least three characters."""
    words = F.filter(
        F.transform(F.split(T.squeeze(F.col("question")), " "), T.normalize_text),
        lambda s: F.length(s) >= 3,
    )
    return questions.select(*TQ, F.explode(F.array_distinct(words)).alias("word"))


def _grams(name: Column) -> Column:
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substring(name, i, F.lit(3)))
    )


def names_containing(names: DataFrame, words: DataFrame) -> DataFrame:
    """(tenant, word, id) for names that contain a word of the tenant's questions.

    A word of three characters or more lies in a name only if its first three do,
    so names and words meet by equality on that piece and the whole word is
    checked afterwards: no all-against-all comparison.
    """
    pieces = names.filter(F.length("name") >= 3).select(
        "tenant_id", "id", "name", F.explode(_grams(F.col("name"))).alias("gram")
    )
    asked = words.select("tenant_id", "word").distinct().withColumn("gram", F.left("word", F.lit(3)))
    return (
        pieces.join(asked, ["tenant_id", "gram"])
        .filter(F.contains("name", "word"))
        .select("tenant_id", "word", "id")
        .distinct()
    )


def graph_search(
    edges: DataFrame, aliases: DataFrame, questions: DataFrame, options: Options = DEFAULTS
) -> DataFrame:
    """Edges whose subject, object or an alias of either contains a question word.

    Rejected edges never show. At most a few per question, lowest edge id first.
    """
    live = edges.filter(F.col("validation_status") != REJECTED)
    ends = live.select("tenant_id", F.col("source_id").alias("id"), F.col("source_norm").alias("name")).union(
        live.select("tenant_id", F.col("target_id").alias("id"), F.col("target_norm").alias("name"))
    ).distinct()
    named = ends.union(
        aliases.select("tenant_id", F.col("entity_id").alias("id"), F.col("alias_normalized").alias("name"))
    )
    words = question_words(questions)
    met = names_containing(named, words)
    # Only the lowest edges of an entity, and of a word, can be among the lowest of a
    # question: a hot entity and a word of many names are cut before any question meets them.
    low = Window.partitionBy("tenant_id", "id").orderBy("edge_id")
    sides = [
        live.select("tenant_id", F.col(end).alias("id"), "edge_id", "document_id", "relation", "source_span")
        .withColumn("_rn", F.row_number().over(low))
        .filter(F.col("_rn") <= options.graph_edges)
        .drop("_rn")
        for end in ("source_id", "target_id")
    ]
    by_word = Window.partitionBy("tenant_id", "word").orderBy("edge_id")
    heads = (
        met.join(sides[0].unionByName(sides[1]), ["tenant_id", "id"])
        .drop("id")
        .distinct()
        .withColumn("_rn", F.row_number().over(by_word))
        .filter(F.col("_rn") <= options.graph_edges)
        .drop("_rn")
    )
    w = Window.partitionBy(*TQ).orderBy("edge_id")
    return (
        words.join(heads, ["tenant_id", "word"])
        .drop("word")
        .distinct()
        .withColumn("edge_rank", F.row_number().over(w))
        .filter(F.col("edge_rank") <= options.graph_edges)
    )


def graph_to_chunks(
    hits: DataFrame, chunks: DataFrame, options: Options = DEFAULTS
) -> DataFrame:
    """Candidate chunks from matched edges: two per edge not yet seen, a dozen in all.

    A chunk scores 2 when the edge's span and the chunk's article lie in one
    another (an absent article lies in any span), else 1. Chunks follow their
    number. Per edge only the first sixteen can matter: earlier edges take at
    most fourteen.
    """
    keep = 2 * options.graph_edges
    hits = hits.withColumn("source_span", F.coalesce("source_span", F.lit("")))
    span, article = F.col("source_span"), F.coalesce("article", F.lit(""))
    related = F.when(
        (span != "") & (F.contains(article, span) | F.contains(span, article)), 2
    ).otherwise(1)
    # Score per (document, span) once; questions sharing an edge share the work.
    pairs = hits.select("tenant_id", "document_id", "source_span").distinct()
    side = chunks.select("tenant_id", "document_id", "chunk_id", "chunk", "article")
    best = Window.partitionBy("tenant_id", "document_id", "source_span").orderBy(
        F.col("_score").desc(), "chunk"
    )
    scored = (
        pairs.join(side, DOC)
        .withColumn("_score", related)
        .withColumn("_rn", F.row_number().over(best))
        .filter(F.col("_rn") <= keep)
        .groupBy("tenant_id", "document_id", "source_span")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_rn", "chunk_id"))), lambda s: s["chunk_id"]
            ).alias("ids")
        )
    )
    listed = hits.join(scored, ["tenant_id", "document_id", "source_span"])
    per_question = listed.groupBy(*TQ).agg(
        F.sort_array(F.collect_list(F.struct("edge_rank", "ids"))).alias("_e")
    )
    picked = F.aggregate(
        "_e",
        F.array().cast("array<string>"),
        lambda acc, e: F.concat(acc, F.slice(F.array_except(e["ids"], acc), 1, 2)),
    )
    return per_question.select(
        *TQ, F.posexplode(F.slice(picked, 1, options.candidates)).alias("_pos", "chunk_id")
    ).select(
        *TQ,
        "chunk_id",
        (F.col("_pos") + 1).alias("graph_rank"),
        F.lit(options.graph_score).alias("score"),
    )


# --------------------------------------------------------------------------- maintenance


def graph_sync(stored: DataFrame, incoming: DataFrame, synced: DataFrame) -> DataFrame:
    """Replace every edge of the synced documents."""
    return stored.join(synced.select(*DOC).distinct(), DOC, "left_anti").unionByName(incoming)


def forget_document_edges(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    return edges.join(deleted.select(*DOC), DOC, "left_anti")


def orphan_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities without an edge; they are kept by design."""
    ends = edges.select("tenant_id", F.col("source_id").alias("entity_id")).union(
        edges.select("tenant_id", F.col("target_id").alias("entity_id"))
    )
    return entities.join(ends, ["tenant_id", "entity_id"], "left_anti")


def list_relations(
    edges: DataFrame, entities: DataFrame, status: str | None = None, limit: int = 200
) -> DataFrame:
    """Edges with the stored names of both ends, newest first, per tenant."""
    size = max(1, min(int(limit), 1000))
    chosen = edges if status is None else edges.filter(F.col("validation_status") == status)
    w = Window.partitionBy("tenant_id").orderBy(F.col("created_at").desc(), "edge_id")
    newest = chosen.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= size)
    s = entities.select("tenant_id", F.col("entity_id").alias("source_id"), F.col("name").alias("subject"))
    o = entities.select("tenant_id", F.col("entity_id").alias("target_id"), F.col("name").alias("object"))
    return newest.join(s, ["tenant_id", "source_id"]).join(o, ["tenant_id", "target_id"])


def validate_relations(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply human decisions; the last one per edge wins and is stamped."""
    last = decisions.groupBy("tenant_id", "edge_id").agg(
        F.max_by(F.struct("status", "validated_by", "decided_at"), F.struct("decided_at", "decision_id")).alias("d")
    )
    joined = edges.join(last, ["tenant_id", "edge_id"], "left")
    return joined.withColumns(
        {
            "validation_status": F.coalesce("d.status", "validation_status"),
            "validated_by": F.col("d.validated_by"),
            "validated_at": F.col("d.decided_at"),
        }
    ).drop("d")


def relation_prompt_lines(edges: DataFrame) -> DataFrame:
    line = F.concat(
        "source_name", F.lit(" → "), "relation", F.lit(" → "), "target_name",
        F.lit(" (fonte: "), F.coalesce("filename", F.lit("n/d")),
        F.lit("; status: "), "validation_status", F.lit(")"),
    )
    return edges.withColumn("line", line)


MODEL_EDGE = t.StructType(
    [
        t.StructField(n, t.StringType())
        for n in (
            "relation", "target_kind", "object_kind", "target", "object", "source_kind",
            "source", "subject", "confidence",
        )
    ]
)


def ingest_model_relations(outputs: DataFrame) -> DataFrame:
    """At most three valid edges per raw model output.

    Input: key columns, ``raw``, ``source_span``. Objects that are not JSON go.
    """
    keys = [c for c in outputs.columns if c != "raw"]
    found = F.regexp_extract_all("raw", F.lit(r"\{[^{}]+\}"), F.lit(0))
    objects = outputs.select(*keys, F.posexplode(found).alias("position", "_json")).filter(
        F.try_parse_json("_json").isNotNull()
    )

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(f"o.{n}"), F.lit("")) for n in names], F.lit(""))

    parsed = objects.select(*keys, "position", F.from_json("_json", MODEL_EDGE).alias("o")).select(
        *keys,
        "position",
        T.strip(first("relation")).alias("relation"),
        T.strip(first("target_kind", "object_kind")).alias("_kind"),
        F.left(T.strip(first("target", "object")), F.lit(255)).alias("target_name"),
        T.strip(first("source_kind")).alias("_source_kind"),
        F.nullif(F.left(T.strip(first("source", "subject")), F.lit(255)), F.lit("")).alias("source_name"),
        F.coalesce(F.col("o.confidence").try_cast("double"), F.lit(0.55)).alias("_confidence"),
    )
    valid = parsed.filter(F.col("relation").isin(*P.MODEL_RELATIONS) & (F.col("target_name") != ""))
    w = Window.partitionBy(*keys).orderBy("position")
    return (
        valid.withColumn("_rn", F.row_number().over(w))
        .filter("_rn <= 3")
        .select(
            *keys,
            F.col("_rn").alias("edge_no"),
            "relation",
            F.when(F.col("_kind").isin(*P.MODEL_KINDS), F.col("_kind")).otherwise("tema").alias("target_kind"),
            "target_name",
            F.when(F.col("_source_kind").isin(*P.MODEL_KINDS), F.col("_source_kind")).alias("source_kind"),
            "source_name",
            F.least(F.lit(0.85), F.greatest(F.lit(0.1), F.col("_confidence"))).alias("confidence"),
            F.lit("llm").alias("extracted_by"),
        )
    )
