"""The data model: a typed table for each class, the quads derived from them, and what validation needs to know."""

from __future__ import annotations

#: Schemas as Spark writes them. One row per instance of a class; a null stands for an absent value, never for zero.
TABLES: dict[str, str] = {
    "organization": "corp_no string, name string, kind_code string, prefecture string, city string, street string, updated_on string, row_idx bigint",
    "ministry": "corp_no string, name string, ministry_code string",
    "abolished_organ": "name string, abolition_date date, succeeded_by array<string>",
    "law": "law_id string, law_num string, law_num_type string, law_title string, abbrev array<string>, promulgation_date date, repeal_status string, jurisdiction array<string>, abolished_jurisdiction array<string>",
    "law_revision": "law_id string, enforcement_date date, amendment_law_num string, status string",
    "budget_project": "fiscal_year int, project_id string, name string, ministry string, budget_amount bigint, basis_law array<string>",
    "expenditure": "fiscal_year int, project_id string, seq int, label string, amount bigint, recipient string, recipient_match_category string, payee_label string, role string, block_id string",
    "expenditure_block": "fiscal_year int, project_id string, block_id string, block_name string, role string, amount bigint, payee_count bigint, paid_by_government boolean, funded_by array<string>, flow_notes array<string>",
    "indirect_cost": "fiscal_year int, project_id string, item string, amount bigint",
    "annual_budget": "fiscal_year int, project_id string, budget_fiscal_year int, initial bigint, supplementary bigint, carried_in bigint, reserve bigint, available bigint, executed bigint, carried_out bigint, next_year_request bigint",
    "unresolved_reference": "iri string, text string, reason string, key string, unresolved_for string",
    "graph_provenance": "g string, derived_from string, generated_on date, source_name string, license_uri string, rights string, generated_by string, source_sha256 array<string>, recorded_on date",
    "quads": "s string, p string, o string, o_kind string, o_lang string, o_dt string, g string",
}

UNRESOLVED_REASONS = ("AMBIGUOUS", "NO_CANDIDATE", "OBSOLETE_ORGANIZATION", "OLD_MINISTRY")
MATCH_CATEGORIES = ("bundled", "resolved", "sentinel_or_nonexistent_houjin_bangou", "unresolved")
#: Corporate numbers that stand for payees without one.
SENTINELS = ("9999999999999",)

#: Each class and the class directly above it.
SUPERCLASSES = (
    ("Organization", "Agent"), ("GovernmentOrgan", "Organization"), ("Ministry", "GovernmentOrgan"), ("AbolishedGovernmentOrgan", "Organization"), ("Law", "Work"), ("LawRevision", "Work"), ("BudgetProject", "MonetaryItem"),
    ("Expenditure", "MonetaryItem"), ("ExpenditureBlock", "MonetaryItem"), ("IndirectCost", "MonetaryItem"), ("AnnualBudget", "MonetaryItem"), ("Agent", "Entity"), ("Work", "Entity"), ("MonetaryItem", "Entity"),
)
#: Fixed order: of several types of an entity the first of these is the one to show.
SPECIFICITY = ("AbolishedGovernmentOrgan", "Ministry", "GovernmentOrgan", "Organization", "LawRevision", "Law", "Expenditure", "ExpenditureBlock", "IndirectCost", "AnnualBudget", "BudgetProject", "UnresolvedReference")
SEARCHABLE = ("Organization", "GovernmentOrgan", "Ministry", "AbolishedGovernmentOrgan", "Law", "BudgetProject")
#: Predicates whose object must be an instance of the class.
REFERENCES = (
    ("jurisdiction", "Organization"), ("ministry", "Ministry"), ("basisLaw", "Law"), ("recipient", "Organization"), ("project", "BudgetProject"),
    ("inBlock", "ExpenditureBlock"), ("fundedBy", "ExpenditureBlock"), ("succeededBy", "Organization"), ("revisionOf", "Law"), ("unresolvedFor", "Entity"),
)
