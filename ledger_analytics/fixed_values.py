"""Tables, patterns, labels and formats that results depend on.

Everything here is data. Thresholds a caller may want to tune are repeated as
defaults of :class:`ledger_analytics.config.AnalysisConfig`.
"""

# --- Fixed values: enumerations -------------------------------------------
TIERS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
FLAGGED_TIERS = ["HIGH", "CRITICAL"]
TIER_FLOORS = [("CRITICAL", 80), ("HIGH", 60), ("MEDIUM", 30)]
TIER_TITLES = {"CRITICAL": "Critical", "HIGH": "High", "MEDIUM": "Medium", "LOW": "Low"}

# --- Fixed values: amount thresholds --------------------------------------
ROUND_THRESHOLDS = [500, 1000, 2500, 5000, 9999, 10000, 25000, 50000, 100000]
APPROVAL_THRESHOLDS = [1000, 2500, 5000, 10000, 25000, 50000, 100000]

# --- Fixed values: Nigrini MAD bands per digit position -------------------
# (upper bound, label, range, description); the last band has no upper bound
MAD_BANDS = {
    1: [
        (0.006, "Close conformity", "0.000 – 0.006", "Data follows Benford very closely."),
        (0.012, "Acceptable conformity", "0.006 – 0.012", "Within tolerance for natural data."),
        (0.015, "Marginal conformity", "0.012 – 0.015", "Borderline — investigate further."),
        (None, "Non-conformity", "> 0.015", "Significant deviation — possible manipulation."),
    ],
    2: [
        (0.008, "Close conformity", "0.000 – 0.008", "Data follows Benford very closely."),
        (0.010, "Acceptable conformity", "0.008 – 0.010", "Within tolerance for natural data."),
        (0.012, "Marginal conformity", "0.010 – 0.012", "Borderline — investigate further."),
        (None, "Non-conformity", "> 0.012", "Significant deviation — possible manipulation."),
    ],
}
CONFORMITY_CUTOFFS = {1: (0.012, 0.015), 2: (0.010, 0.012)}
CHI_SQUARE_CRITICAL = {1: 15.51, 2: 16.92}

# --- Fixed values: description patterns (regex, weight, label) ------------
DESCRIPTION_PATTERNS = [
    (r"\bmisc(ellaneous)?\b", 35, "vague: miscellaneous"),
    (r"\bother\b", 30, "vague: other"),
    (r"\bservices?\b$", 25, "vague: services (only)"),
    (r"\bconsulting\b$", 20, "vague: consulting (only)"),
    (r"\bfees?\b$", 25, "vague: fees (only)"),
    (r"\bexpenses?\b$", 20, "vague: expenses (only)"),
    (r"\bgeneral\b", 15, "vague: general"),
    (r"\bvarious\b", 20, "vague: various"),
    (r"\bwork\s+performed\b", 20, "vague: work performed"),
    (r"\bprofessional\s+services?\b", 15, "vague: professional services"),
    (r"\bmanagement\s+services?\b", 20, "vague: management services"),
    (r"^[-–—n\/a]+$", 45, "empty: N/A placeholder"),
    (r"^(tbd|tba|none|null)$", 45, "empty: placeholder text"),
    (r"^\d+$", 50, "empty: numeric only"),
    (r"\bgift\b", 30, "category: gift"),
    (r"\bpersonal\b", 40, "category: personal"),
    (r"\bcash\s+advance\b", 50, "category: cash advance"),
    (r"\bloan\b", 35, "category: loan"),
    (r"\badjust(ment)?\b", 20, "journal: adjustment"),
    (r"\bcorrect(ion)?\b", 15, "journal: correction"),
    (r"\bwrite[- ]?off\b", 25, "journal: write-off"),
    (r"\breclassif(y|ication)\b", 15, "journal: reclassification"),
]
MISSING_DESCRIPTION_LABEL = "missing: no description provided"
SHORT_DESCRIPTION_LABEL = "length: very short description"

# --- Fixed values: header aliases, first match in list order wins ---------
HEADER_ALIASES = {
    "amount": ["amount", "amt", "total", "dmbtr", "entered_dr", "invoice_amount", "value"],
    "date": ["date", "invoice_date", "posting_date", "budat", "trans_date", "transaction_date"],
    "vendor": ["vendor", "vendor_name", "supplier", "payee", "lifnr", "company"],
    "invoice_id": ["invoice_id", "invoice_number", "inv_num", "reference", "doc_number", "belnr"],
    "description": ["description", "desc", "memo", "notes", "sgtxt", "text"],
    "address": ["address", "vendor_address", "supplier_address", "street_address", "addr", "location"],
}
DATE_FORMATS = ["ISO", "US (MM/DD)", "EU (DD/MM)", "ambiguous", "unknown"]

# --- Fixed values: geocoder place types that do not count as a business ---
BLOCKED_ADDRESS_TYPES = [
    "residential", "house", "apartment", "mailbox", "virtual_office", "place", "hamlet",
]

# --- Fixed values: detectors (key, name, short label, methodology basis) --
DETECTORS = [
    ("BENFORD_1ST", "Benford's Law (1st digit)", "Benford",
     "Nigrini, Benford's Law (2012); AICPA AU-C 240"),
    ("BENFORD_2ND", "Benford's Law (2nd digit)", "Benford 2", "Nigrini, Benford's Law (2012)"),
    ("ROUND_NUMBER", "Round Number", "Round #", "ACFE Fraud Examiners Manual"),
    ("ISOLATION_FOREST", "Isolation Forest", "Outlier", "Liu, Ting & Zhou (2008)"),
    ("RSF", "Relative Size Factor", "RSF", "Nigrini, Forensic Analytics (2011)"),
    ("EXACT_DUPLICATE", "Exact Duplicate", "Duplicate", "AICPA AU-C 240"),
    ("FUZZY_DUPLICATE", "Fuzzy Duplicate", "Fuzzy Dup", "COSO Internal Control Framework"),
    ("SPLIT_INVOICE", "Split Invoice", "Split", "ACFE 2024 Report to the Nations"),
    ("DESCRIPTION_AUDIT", "Description Audit", "Desc.", "ACFE Fraud Examiners Manual"),
    ("EDGAR_UNVERIFIED", "EDGAR Unverified", "EDGAR", "SEC EDGAR public API"),
    ("OFAC_HIT", "OFAC Hit", "OFAC", "OFAC SDN List"),
    ("ADDRESS_INVALID", "Address Invalid", "Address", "ACFE Fraud Examiners Manual — Vendor Fraud"),
]
# the nine internal detectors of the dashboards, in tie-break order
DASHBOARD_DETECTORS = [
    "EXACT_DUPLICATE", "RSF", "ISOLATION_FOREST", "SPLIT_INVOICE", "ROUND_NUMBER",
    "DESCRIPTION_AUDIT", "BENFORD_1ST", "FUZZY_DUPLICATE", "BENFORD_2ND",
]
# the ten detectors of the transaction detail, in display order
DETAIL_DETECTORS = [
    "EXACT_DUPLICATE", "RSF", "ISOLATION_FOREST", "SPLIT_INVOICE", "ROUND_NUMBER",
    "DESCRIPTION_AUDIT", "BENFORD_1ST", "OFAC_HIT", "EDGAR_UNVERIFIED", "ADDRESS_INVALID",
]

# --- Fixed values: detail messages (key -> triggered text, clear text) ----
DETAIL_MESSAGES = {
    "EXACT_DUPLICATE": (
        "Exact duplicate detected — same vendor, amount, and date.",
        "No exact duplicate found.",
    ),
    "RSF": (
        "Amount is %s× the median for this vendor.",
        "Amount is within normal range for this vendor.",
    ),
    "ISOLATION_FOREST": (
        "Statistical outlier detected (score: %s/100).",
        "Transaction is within expected distribution range.",
    ),
    "SPLIT_INVOICE": (
        "Possible invoice splitting — cluster of same-vendor transactions near approval threshold.",
        "No structuring pattern detected.",
    ),
    "ROUND_NUMBER": (
        "Amount is suspiciously round or just below an approval threshold.",
        "No suspicious rounding detected.",
    ),
    "DESCRIPTION_AUDIT": (
        "Description matched high-risk pattern (score: %s/100).",
        "Description appears specific and legitimate.",
    ),
    "BENFORD_1ST": (
        "First digit (%s) deviates from Benford's Law.",
        "First digit (%s) conforms to Benford's Law.",
    ),
    "OFAC_HIT": (
        "Vendor name matches an entry on the OFAC sanctions list — CRITICAL escalation.",
        "Vendor name does not match any OFAC SDN list entry.",
    ),
    "EDGAR_UNVERIFIED": (
        "Vendor not in SEC EDGAR registry AND amount is unusually large — possible shell entity.",
        "Vendor is not an SEC filer — typical for private companies, no other red flags.",
    ),
    "ADDRESS_INVALID": (
        "Vendor address could not be geocoded or resolves to a residential location.",
        "Vendor address geocodes to a valid commercial location.",
    ),
}
DETAIL_NOT_CHECKED = {
    "OFAC_HIT": "OFAC screening not available for this vendor.",
    "EDGAR_UNVERIFIED": "EDGAR verification not available for this vendor.",
    "ADDRESS_INVALID": "No address provided for geocoding.",
}
DETAIL_REGISTRY_CONFIRMED = "Vendor confirmed in SEC EDGAR registry."

# What a reject line says before the cell
REJECT_AMOUNT = "Unparseable amount: "
REJECT_DATE = "Unreadable date: "
