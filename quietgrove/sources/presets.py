"""Column roles of well-known public tables."""

from __future__ import annotations

from quietgrove.spec import TableSpec

# Column names, roles and file formats of the tables.
ABALONE = TableSpec(
    "abalone",
    ("sex", "length", "diameter", "height", "whole weight", "shucked weight", "viscera weight",
     "shell weight", "rings"),
    target="rings", categorical=("sex",),
    numeric=("length", "diameter", "height", "whole weight", "shucked weight", "viscera weight",
             "shell weight"))

YEAR = TableSpec(
    "yearMSD", ("year", *[f"audio_{i}" for i in range(1, 91)]), target="year",
    numeric=tuple(f"audio_{i}" for i in range(1, 91)))

ADULT = TableSpec(
    "adult",
    ("age", "workclass", "fnlwgt", "education", "education_num", "marital_status", "occupation",
     "relationship", "race", "sex", "capital_gain", "capital_loss", "hours_per_week",
     "native_country", "income"),
    target="income", numeric=("age", "education_num", "capital_gain", "capital_loss",
                              "hours_per_week"),
    categorical=("workclass", "education", "marital_status", "occupation", "relationship", "race",
                 "sex", "native_country"),
    task="binary")

BCW = TableSpec(
    "bcw",
    ("id", "clump thickness", "cell size", "cell shape", "marginal adhesion",
     "epithelial cell size", "bare nuclei", "bland chromatin", "normal nucleoli", "mitoses",
     "class"),
    target="class",
    categorical=("clump thickness", "cell size", "cell shape", "marginal adhesion",
                 "epithelial cell size", "bare nuclei", "bland chromatin", "normal nucleoli",
                 "mitoses"),
    task="binary")

QUESTIONS = 42
QUESTIONNAIRES = TableSpec(
    "questionnaires",
    (*[f"Q{i}{part}" for i in range(1, QUESTIONS + 1) for part in "AIE"],
     "country", "source", "introelapse", "testelapse", "surveyelapse",
     *[f"TIPI{i}" for i in range(1, 11)], *[f"VCL{i}" for i in range(1, 17)],
     "education", "urban", "gender", "engnat", "age", "screensize", "uniquenetworklocation",
     "hand", "religion", "orientation", "race", "voted", "married", "familysize", "major"),
    target="Q1A", categorical=tuple(f"Q{i}A" for i in range(2, QUESTIONS + 1)),
    sep="\t", header=True)

COMPANY_FLAGS = (
    "company_allows_BYOD", "company_does_yearly_pentest", "company_uses_RBAC",
    "company_does_red_teaming", "company_has_2FA", "company_has_password_policy",
    "company_trains_employees_against_social_engineering", "company_has_antivirus",
    "company_has_patching_process", "company_has_ingress_firewall",
    "company_has_egress_firewall", "company_uses_3rd_party", "company_has_ciso",
    "company_has_threat_intelligence_team", "company_monitors_IOCs", "company_has_IDS",
    "company_has_IPS", "company_separates_systems", "company_does_daily_backups",
    "company_has_recovery_plan", "company_has_incident_response_team",
    "company_has_pii", "company_has_pci", "company_has_phi", "company_has_credentials",
    "company_has_other")
OBJECTIVES = {"loss": "company_suffers_a_loss", "cost": "cost_of_loss"}


def synthetic(letter: str, objective: str = "loss") -> TableSpec:
    """Company tables A to D; ``objective`` names the target."""
    return TableSpec(
        f"synthetic_{letter}",
        ("company_size", "company_sector", *COMPANY_FLAGS, *OBJECTIVES.values()),
        target=OBJECTIVES[objective],
        categorical=("company_size", "company_sector", *COMPANY_FLAGS), header=True)


SPECS = {s.name: s for s in (ABALONE, YEAR, ADULT, BCW, QUESTIONNAIRES,
                             *[synthetic(x) for x in "ABCD"])}
