"""The vector store and the graph store: what retrieval asks of them, over versioned tables.

Every method works on whole tables of requests (tenant by tenant, many at once) and reads the parts they touch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.operators import graph, store, vectors
from corpusloom.sources.versioned import PART, VersionedTable, with_part

DOC = ["tenant_id", "document_id"]


def parts_of(rows: DataFrame) -> DataFrame:
    return with_part(rows.select(*DOC)).select(*PART).distinct()


@dataclass(frozen=True)
class VectorStore:
    """Chunks with text, metadata and vectors."""

    table: VersionedTable

    def health(self) -> bool:
        """Whether a version can be read. Never raises."""
        try:
            return bool(self.table.versions()) and self.table.manifest().limit(1).count() >= 0
        except Exception:  # noqa: BLE001
            return False

    def upsert(self, chunks: DataFrame) -> int:
        """Insert chunks, or replace those of the same id."""
        touched = parts_of(chunks)
        return self.table.replace(store.upsert_chunks(self.table.read(only=touched), chunks), touched)

    def delete_documents(self, documents: DataFrame) -> int:
        touched = parts_of(documents)
        return self.table.replace(store.delete_documents(self.table.read(only=touched), documents), touched)

    def delete_ids(self, ids: DataFrame) -> int:
        """Remove chunks by (tenant_id, chunk_id)."""
        tenants = self.table.manifest().join(ids.select("tenant_id").distinct(), "tenant_id", "left_semi")
        touched = parts_of(self.table.read(only=tenants).join(ids, store.ID, "left_semi"))
        return self.table.replace(self.table.read(only=touched).join(ids, store.ID, "left_anti"), touched)

    def update_status(self, updates: DataFrame) -> int:
        """Human decisions on the validity of documents; vectors stay as they are."""
        touched = parts_of(updates)
        return self.table.replace(store.apply_status_updates(self.table.read(only=touched), updates), touched)

    def query(self, questions: DataFrame, options: Options = DEFAULTS) -> DataFrame:
        """Nearest chunks of each question (tenant_id, query_id, embedding)."""
        tenants = self.table.manifest().join(questions.select("tenant_id").distinct(), "tenant_id", "left_semi")
        return vectors.cosine_topk(self.table.read(only=tenants), questions, options)

    def get_chunks(self, ids: DataFrame) -> DataFrame:
        tenants = self.table.manifest().join(ids.select("tenant_id").distinct(), "tenant_id", "left_semi")
        return store.fetch_chunks(self.table.read(only=tenants), ids)

    def all_chunks(self, tenant: str) -> DataFrame:
        return self.table.of_tenant(tenant).select("chunk_id", "text")

    def chunk_ids_for_document(self, tenant: str, document: str) -> DataFrame:
        return self.table.of_tenant(tenant).where(F.col("document_id") == document).select("chunk_id")

    def count_chunks(self, tenant: str) -> int:
        return self.table.of_tenant(tenant).count()

    def list_documents(self, tenant: str) -> DataFrame:
        return store.list_documents(self.table.of_tenant(tenant))

    def tenant_text_bytes(self, tenant: str) -> int:
        row = store.tenant_quota(self.table.of_tenant(tenant)).first()
        return row["stored_bytes"] if row else 0

    def tenant_ids(self) -> DataFrame:
        """Read off the manifest; no chunk is read."""
        return self.table.manifest().select("tenant_id").distinct()


@dataclass(frozen=True)
class GraphStore:
    """Edges with provenance."""

    table: VersionedTable

    def sync_documents(self, edges: DataFrame, documents: DataFrame) -> int:
        """Replace every edge of the synced documents."""
        touched = parts_of(documents.select(*DOC).unionByName(edges.select(*DOC)))
        return self.table.replace(graph.graph_sync(self.table.read(only=touched), edges, documents), touched)

    def forget_documents(self, documents: DataFrame) -> int:
        touched = parts_of(documents)
        return self.table.replace(graph.forget_document_edges(self.table.read(only=touched), documents), touched)

    def search_context(self, questions: DataFrame, aliases: DataFrame, options: Options = DEFAULTS) -> DataFrame:
        tenants = self.table.manifest().join(questions.select("tenant_id").distinct(), "tenant_id", "left_semi")
        return graph.graph_search(self.table.read(only=tenants), aliases, questions, options)

    def list_relations(self, tenant: str, entities: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
        return graph.list_relations(self.table.of_tenant(tenant), entities.where(F.col("tenant_id") == tenant), status, limit)

    def set_validation_status(self, decisions: DataFrame) -> int:
        """Human decisions (tenant_id, edge_id, decision_id, status, validated_by, decided_at); edges without one stay."""
        tenants = self.table.manifest().join(decisions.select("tenant_id").distinct(), "tenant_id", "left_semi")
        decided = self.table.read(only=tenants).join(decisions, ["tenant_id", "edge_id"], "left_semi")
        touched = parts_of(decided)
        stored = self.table.read(only=touched)
        judged = stored.join(decisions, ["tenant_id", "edge_id"], "left_semi")
        rest = stored.join(decisions, ["tenant_id", "edge_id"], "left_anti")
        return self.table.replace(graph.validate_relations(judged, decisions).select(*stored.columns).unionByName(rest), touched)
