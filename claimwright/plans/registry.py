"""The single registry of types, columns, edges, vocabularies and thresholds.

Spark schemas, validation rules, views, the SQL gate and the catalog all read it, so a
column approved in a new registry version can be claimed at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values -----------------------------------------------------------------------

ENTITY_COLUMNS = {
    "person": {"canonical_name": "string", "birth_date": "string", "nationality": "string"},
    "organization": {"canonical_name": "string", "org_type": "string", "founded_year": "bigint", "headquarters": "string"},
    "product": {
        "canonical_name": "string", "release_date": "string", "category": "string", "billing_period": "string",
        "included_quota_units": "double", "quota_unit_name": "string", "trial_period_days": "bigint",
    },
    "project": {"canonical_name": "string", "started_at": "string", "ended_at": "string"},
    "contract": {
        "canonical_name": "string", "contract_type": "string", "effective_date": "string", "valid_until": "string",
        "jurisdiction": "string", "url": "string", "version": "string", "sla_uptime_percent": "double",
        "sla_response_time_minutes": "double", "rto_hours": "double", "rpo_hours": "double",
    },
}

#: junction -> ((from column, from type), (to column, to type), cardinality key, attribute claim columns).
JUNCTIONS = {
    "employment": (("person_id", "person"), ("organization_id", "organization"), ("person_id", "organization_id", "start_date"), ("role", "end_date")),
    "manufacturing": (("product_id", "product"), ("organization_id", "organization"), ("product_id",), ()),
    "org_hierarchy": (("parent_org_id", "organization"), ("child_org_id", "organization"), ("child_org_id",), ()),
    "product_variant": (("parent_product_id", "product"), ("variant_product_id", "product"), ("variant_product_id",), ()),
    "governance": (("product_id", "product"), ("contract_id", "contract"), ("product_id", "contract_id"), ()),
    "compliance": (("contract_id", "contract"), ("standard_name", None), ("contract_id", "standard_name"), ()),
}

ENUMS = {
    ("organization", "org_type"): ("company", "lab", "team", "university", "government", "nonprofit", "other"),
    ("product", "billing_period"): ("monthly", "annual", "one_time"),
    ("contract", "contract_type"): ("service_description", "terms_of_service", "sla", "security_addendum", "data_processing", "other"),
}

#: (least, greatest) of numeric columns; None is open.
RANGES = {
    ("product", "included_quota_units"): (0, None),
    ("product", "trial_period_days"): (0, None),
    ("contract", "sla_uptime_percent"): (0, 100),
    ("contract", "sla_response_time_minutes"): (0, None),
    ("contract", "rto_hours"): (0, None),
    ("contract", "rpo_hours"): (0, None),
}

STRIP_TOKENS = (
    "株式会社", "有限会社", "合同会社", "（株）", "(株)", "㈱",
    "inc", "inc.", "corp", "corp.", "corporation", "co.", "co", "ltd", "ltd.", "llc", "k.k.", "kk",
)
CONTRACT_SUFFIXES = ("個別契約書", "契約書", "別表", "補遺", "書", "版")

CLAIM_STATUSES = ("active", "conflicted", "superseded")
STAGING_STATUSES = ("pending", "approved", "rejected", "applied")
PROPOSAL_KINDS = ("new_table", "new_column", "rename", "split", "merge")
PROPOSAL_STATUSES = ("pending", "approved", "rejected", "applied")

CLAIM_CONFIDENCE_DELTA = 0.1
LOW_CONFIDENCE = 0.3
FALLBACK_CONFIDENCE = 0.1
MACHINE_CONFIDENCE_CAP = 0.95
HUMAN_DOCUMENT_ID = 1
WEAK_PROMOTION_N = 5
CHUNK_CHARS = 6000
HINT_TRIGRAM, HINT_COSINE, HINT_TOP, HINT_CHARS = 0.20, 0.55, 3, 700
FEWSHOT_TOP, EXTRA_TABLES_TOP = 3, 5
CANDIDATE_TRIGRAM, CANDIDATE_COSINE, CANDIDATE_TOP, CANDIDATE_TOP_ACROSS = 0.3, 0.70, 5, 3
SQL_LIMIT, LIST_LIMIT, WEAK_LIMIT, FTS_TOP, PROVENANCE_TOP, PROVENANCE_STRINGS = 50, 300, 500, 4, 8, 50

# ------------------------------------------------------------------------------------

CLAIMS = {
    "entity_table": "string", "entity_id": "bigint", "column_name": "string", "value": "string",
    "document_id": "bigint", "evidence": "string", "confidence": "double", "seq": "bigint",
}
EXISTENCE = {"junction": "string", "edge_id": "bigint", "document_id": "bigint", "evidence": "string", "confidence": "double", "seq": "bigint"}
DOCUMENTS = {"id": "bigint", "slug": "string", "title": "string", "path": "string", "body": "string", "ingested_at": "timestamp"}
WEAK = {
    "subject_table": "string", "subject_id": "bigint", "predicate": "string", "object_table": "string", "object_id": "bigint", "object_text": "string",
    "document_id": "bigint", "evidence": "string", "confidence": "double", "promoted_to": "string",
}
_SPEC = "struct<table: string, extends_from: string, additional_columns: array<struct<name: string, type: string, example: string>>, rationale: string>"
#: Section -> the type of its items, in an extraction payload.
PAYLOAD = {
    "entities": (
        "struct<proposed_type: string, canonical_name: string, mention_surface: string, attributes: map<string, string>, confidence: double, evidence: string, "
        f"new_table_proposal: {_SPEC}, existing_matches: array<struct<table: string, name: string, rationale: string>>>"
    ),
    "relations": "struct<proposed_junction: string, `from`: string, `to`: string, attributes: map<string, string>, evidence: string, confidence: double>",
    "weak_relations": "struct<subject: string, predicate: string, `object`: string, evidence: string, confidence: double>",
}


def ddl(columns: dict[str, str]) -> str:
    """A column list as Spark reads schemas."""
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


@dataclass(frozen=True)
class Registry:
    """A version of the schema: table name -> {column: type}; claimable columns follow from it."""

    entities: dict[str, dict[str, str]] = field(default_factory=lambda: ENTITY_COLUMNS)
    extra: dict[str, dict[str, str]] = field(default_factory=dict)
    version: int = 4

    def tables(self) -> dict[str, dict[str, str]]:
        """Every table with its columns: entities, aliases, claims, edges and the shared tables."""
        out: dict[str, dict[str, str]] = {"documents": DOCUMENTS}
        claim = {k: v for k, v in CLAIMS.items() if k not in ("entity_table", "entity_id")} | {"status": "string", "conflict_group": "bigint"}
        for name, columns in self.entities.items():
            out[name] = {"id": "bigint", "norm_key": "string", **columns}
            out[f"{name}_aliases"] = {f"{name}_id": "bigint", "alias": "string", "norm_key": "string"}
            out[f"{name}_claims"] = {f"{name}_id": "bigint", **claim}
        for name, (a, b, _, attributes) in JUNCTIONS.items():
            ends = {a[0]: "bigint", b[0]: "bigint" if b[1] else "string"}
            more = {"employment": {"role": "string", "start_date": "string", "end_date": "string"}, "compliance": {"certified_until": "string"}}
            out[name] = {"id": "bigint", **ends, **more.get(name, {}), "document_id": "bigint", "evidence": "string", "confidence": "double"}
            out[f"{name}_existence_claims"] = {f"{name}_id": "bigint", "document_id": "bigint", "evidence": "string", "confidence": "double", "status": "string"}
            if attributes:
                out[f"{name}_claims"] = {f"{name}_id": "bigint", **claim}
        out["weak_relations"] = WEAK
        out["entity_mentions"] = {"document_id": "bigint", "entity_table": "string", "entity_id": "bigint", "surface_form": "string"}
        return out | self.extra

    def with_table(self, name: str, columns: dict[str, str]) -> Registry:
        return replace(self, extra=self.extra | {name: columns}, version=self.version + 1)

    def with_column(self, table: str, column: str, kind: str) -> Registry:
        if table in self.entities:
            return replace(self, entities=self.entities | {table: self.entities[table] | {column: kind}}, version=self.version + 1)
        columns = self.tables()[table] | {column: kind}
        return replace(self, extra=self.extra | {table: columns}, version=self.version + 1)

    def renamed(self, table: str, old: str, new: str) -> Registry:
        swap = lambda columns: {new if k == old else k: v for k, v in columns.items()}
        if table in self.entities:
            return replace(self, entities=self.entities | {table: swap(self.entities[table])}, version=self.version + 1)
        return replace(self, extra=self.extra | {table: swap(self.tables()[table])}, version=self.version + 1)


#: Tables always in the schema text, in order.
CORE_TABLES = ("documents", *ENTITY_COLUMNS, *JUNCTIONS)
