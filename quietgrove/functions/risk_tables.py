"""Fixed values of the company risk model: lookup tables, stated as given.

Costs are in thousands of dollars. Conditional tables list (flag, flag, ..., p); the flags
are in the order of the ``*_KEYS`` tuples.
"""

from __future__ import annotations

LOSS_PRIOR = 0.10
OLD_LOSS_PRIOR = 0.20

SIZE_PROBABILITY = {"small": 0.68, "large": 0.32}

SECTOR_GIVEN_SIZE = {
    "small": {
        "hospitality": 0.03, "public_entity": 0.03, "other": 0.11, "nonprofit": 0.05,
        "education": 0.05, "technology": 0.06, "manufacturing": 0.08,
        "financial_services": 0.09, "retail": 0.09, "healthcare": 0.19,
        "professional_services": 0.22},
    "large": {
        "manufacturing": 0.03, "technology": 0.03, "energy": 0.04, "hospitality": 0.04,
        "professional_services": 0.04, "other": 0.09, "education": 0.08,
        "financial_services": 0.15, "retail": 0.24, "healthcare": 0.26},
}

FEATURE_PROBABILITY = {
    "company_allows_BYOD": 0.44,
    "company_does_yearly_pentest": 0.36,
    "company_uses_RBAC": 0.85,
    "company_does_red_teaming": 0.33,
    "company_has_2FA": 0.78,
    "company_has_password_policy": 0.88,
    "company_trains_employees_against_social_engineering": 0.70,
    "company_has_antivirus": 0.95,
    "company_has_patching_process": 0.60,
    "company_has_ingress_firewall": 0.83,
    "company_has_egress_firewall": 0.61,
    "company_uses_3rd_party": 0.87,
    "company_has_ciso": 0.67,
    "company_has_IDS": 0.94,
    "company_has_IPS": 0.81,
    "company_has_threat_intelligence_team": 0.38,
    "company_has_incident_response_team": 0.46,
    "company_monitors_IOCs": 0.44,
    "company_separates_systems": 0.79,
    "company_does_daily_backups": 0.91,
    "company_has_recovery_plan": 0.33,
}

FEATURE_GIVEN_LOSS = {
    "company_allows_BYOD": 0.14,
    "company_does_yearly_pentest": 0.23,
    "company_uses_RBAC": 0.67,
    "company_has_patching_process": 0.828,
    "company_has_antivirus": 0.81,
    "company_has_ingress_firewall": 0.84,
    "company_has_egress_firewall": 0.76,
    "company_uses_3rd_party": 0.79,
    "company_has_ciso": 0.68,
}

R2PS_KEYS = ("company_does_red_teaming", "company_has_2FA", "company_has_password_policy",
             "company_trains_employees_against_social_engineering")
R2PS_GIVEN_LOSS = (
    (1, 1, 1, 1, 0.08), (1, 1, 1, 0, 0.13), (1, 1, 0, 1, 0.16), (1, 1, 0, 0, 0.24),
    (1, 0, 1, 1, 0.04), (1, 0, 1, 0, 0.31), (1, 0, 0, 1, 0.17), (1, 0, 0, 0, 0.03),
    (0, 1, 1, 1, 0.52), (0, 1, 1, 0, 0.62), (0, 1, 0, 1, 0.48), (0, 1, 0, 0, 0.37),
    (0, 0, 1, 1, 0.71), (0, 0, 1, 0, 0.84), (0, 0, 0, 1, 0.59), (0, 0, 0, 0, 0.92),
)

PDTI_KEYS = ("company_has_IPS", "company_has_IDS", "company_has_threat_intelligence_team",
             "company_monitors_IOCs")
PDTI_GIVEN_LOSS = (
    (1, 1, 1, 1, 0.07), (1, 1, 1, 0, 0.18), (1, 1, 0, 1, 0.09), (1, 1, 0, 0, 0.15),
    (1, 0, 1, 1, 0.11), (1, 0, 1, 0, 0.22), (1, 0, 0, 1, 0.29), (1, 0, 0, 0, 0.47),
    (0, 1, 1, 1, 0.09), (0, 1, 1, 0, 0.14), (0, 1, 0, 1, 0.27), (0, 1, 0, 0, 0.15),
    (0, 0, 1, 1, 0.12), (0, 0, 1, 0, 0.08), (0, 0, 0, 1, 0.18), (0, 0, 0, 0, 0.84),
)

PWD_KEYS = ("company_has_password_policy", "company_has_2FA")
PWD = ((1, 1, 0.91), (1, 0, 0.84), (0, 1, 0.15), (0, 0, 0.61))

SOC_KEYS = ("company_trains_employees_against_social_engineering",
            "company_has_password_policy", "company_does_red_teaming")
SOC = (
    (1, 1, 1, 0.97), (1, 1, 0, 0.81), (1, 0, 1, 0.85), (1, 0, 0, 0.72),
    (0, 1, 1, 0.06), (0, 1, 0, 0.58), (0, 0, 1, 0.02), (0, 0, 0, 0.44),
)

IPS_KEYS = ("company_has_IPS", "company_has_IDS")
IPS = ((1, 1, 0.97), (1, 0, 0.75), (0, 1, 0.28), (0, 0, 0.54))

THREAT_KEYS = ("company_has_threat_intelligence_team", "company_has_IDS")
THREAT = ((1, 1, 0.79), (1, 0, 0.31), (0, 1, 0.48), (0, 0, 0.88))

IOC_KEYS = ("company_monitors_IOCs", "company_has_threat_intelligence_team")
IOC = ((1, 1, 0.93), (1, 0, 0.74), (0, 1, 0.22), (0, 0, 0.39))

# Given for companies that have an incident response team.
IR_KEYS = ("company_has_threat_intelligence_team", "company_has_IDS", "company_has_IPS")
IR = (
    (1, 1, 1, 0.88), (1, 1, 0, 0.76), (1, 0, 1, 0.78), (1, 0, 0, 0.62),
    (0, 1, 1, 0.69), (0, 1, 0, 0.53), (0, 0, 1, 0.57), (0, 0, 0, 0.41),
)

CONDITIONAL_TABLES = {
    "R2PS": (R2PS_KEYS, R2PS_GIVEN_LOSS), "PDTI": (PDTI_KEYS, PDTI_GIVEN_LOSS),
    "PWD": (PWD_KEYS, PWD), "SOC": (SOC_KEYS, SOC), "IPS": (IPS_KEYS, IPS),
    "THREAT": (THREAT_KEYS, THREAT), "IOC": (IOC_KEYS, IOC), "IR": (IR_KEYS, IR),
}

DATA_COST = {
    "small": {"pci": 392, "phi": 259, "pii": 163, "credentials": 167, "other": 128},
    "large": {"pci": 4900, "phi": 3200, "pii": 6500, "credentials": 575, "other": 1514},
}

# Data types that companies of a sector may hold.
SECTOR_DATA = {
    "gaming_casino": ("pii", "phi", "pci"),
    "telecommunications": ("pii", "credentials", "other"),
    "entertainment": ("pii", "phi", "pci"),
    "media": ("pii", "credentials", "other"),
    "restaurant": ("pii", "credentials", "other", "pci"),
    "energy": ("pii", "credentials", "other", "pci"),
    "transportation": ("pii", "credentials", "other"),
    "hospitality": ("pii", "credentials", "other", "pci"),
    "public_entity": ("pii", "credentials", "other"),
    "other": ("pii", "credentials", "other"),
    "nonprofit": ("pii", "credentials", "other"),
    "education": ("pii", "credentials", "other"),
    "technology": ("pii", "credentials", "other"),
    "manufacturing": ("pii", "credentials", "other", "pci"),
    "financial_services": ("pii", "credentials", "other", "pci"),
    "retail": ("pii", "credentials", "other", "pci"),
    "healthcare": ("pii", "phi", "credentials", "other"),
    "professional_services": ("pii", "credentials", "other"),
}

# sector: (least, mean, most) cost of a breach
BREACH_COST = {
    "small": {
        "gaming_casino": (80, 80, 1100), "telecommunications": (4, 542, 2000),
        "entertainment": (7, 154, 764), "media": (5, 328, 2500), "restaurant": (2, 68, 367),
        "energy": (2, 319, 5000), "transportation": (5, 590, 17500),
        "hospitality": (6, 260, 5700), "public_entity": (3, 96, 1400), "other": (1, 81, 800),
        "nonprofit": (1, 72, 1600), "education": (2, 163, 1500),
        "technology": (5, 455, 10000), "manufacturing": (2, 200, 20000),
        "financial_services": (1, 106, 3400), "retail": (2, 240, 7500),
        "healthcare": (1, 182, 9000), "professional_services": (1, 90, 3600)},
    "large": {
        "gaming_casino": (80, 80, 80), "telecommunications": (400, 400, 400),
        "energy": (2500, 4200, 5000), "transportation": (80000, 80000, 80000),
        "hospitality": (738, 4200, 10000), "public_entity": (505, 505, 505),
        "other": (100, 219, 322), "nonprofit": (13, 13, 13), "education": (3, 216, 875),
        "technology": (1000, 2600, 4100), "manufacturing": (20, 16500, 33000),
        "financial_services": (72, 10700, 64000), "retail": (60, 4200, 16800),
        "healthcare": (5, 3400, 15000), "professional_services": (332, 3100, 6200)},
}

CRISIS_COST = {
    "small": {
        "gaming_casino": 342, "telecommunications": 533, "entertainment": 124, "media": 77,
        "restaurant": 66, "energy": 73, "transportation": 86.7, "hospitality": 155,
        "public_entity": 72, "other": 62, "nonprofit": 71, "education": 114,
        "technology": 173, "manufacturing": 37, "financial_services": 78, "retail": 228,
        "healthcare": 157, "professional_services": 57},
    "large": {
        "gaming_casino": 60, "telecommunications": 218, "entertainment": 258, "media": 258,
        "restaurant": 258, "energy": 258, "transportation": 258, "hospitality": 4100,
        "public_entity": 258, "other": 258, "nonprofit": 11, "education": 211,
        "technology": 1200, "manufacturing": 33000, "financial_services": 12500,
        "retail": 1800, "healthcare": 2400, "professional_services": 3100},
}

# flag: (change if set, change if not) of the cost fractions, which start at 1
CRISIS_FRACTION = {
    "company_has_incident_response_team": (-0.24, 0.21),
    "company_separates_systems": (-0.37, 0.34),
    "company_does_daily_backups": (-0.36, 0.34),
    "company_has_recovery_plan": (-0.57, 0.52),
}
BREACH_FRACTION = {
    "company_separates_systems": (-0.53, 0.51),
    "company_does_daily_backups": (-0.27, 0.20),
}

# The older model: three protections.
OLD_FEATURE_PROBABILITY = {
    "company_has_antivirus": 0.95,
    "company_trains_employees_against_social_engineering": 0.70,
    "company_has_patching_process": 0.60,
}
OLD_FEATURE_GIVEN_LOSS = {
    "small": {
        "company_has_antivirus": 0.73,
        "company_trains_employees_against_social_engineering": 0.52,
        "company_has_patching_process": 0.93},
    "large": {
        "company_has_antivirus": 0.77,
        "company_trains_employees_against_social_engineering": 0.88,
        "company_has_patching_process": 0.74},
}
