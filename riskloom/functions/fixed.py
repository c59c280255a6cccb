"""Fixed values that results depend on: word lists, lookup tables, patterns and thresholds."""

# Formats of identifiers.
CIN_PATTERN = r"^[UL]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}$"
PAN_PATTERN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"

# Headers of the company master, by target column.
HEADER_ALIASES = {
    "cin": ["cin", "company_cin", "corporate_identity_number", "company_identification_number"],
    "company_name": ["company_name", "name", "company", "companyname"],
    "status": ["status", "company_status", "companystatus"],
    "registered_state": ["registered_state", "state", "state_code", "companystatecode"],
    "industrial_class": ["industrial_class", "nic_code", "industry_code", "industrial_activity", "companyindustrialclassification"],
    "date_of_incorporation": ["date_of_incorporation", "incorporation_date", "date_of_registration", "companyregistrationdate_date"],
    "date_of_last_agm": ["date_of_last_agm", "last_agm_date", "agm_date"],
    "authorized_capital": ["authorized_capital", "authorised_capital", "authorizedcapital"],
    "paid_up_capital": ["paid_up_capital", "paidup_capital", "paidupcapital"],
    "company_category": ["company_category", "category", "companycategory"],
    "company_subcategory": ["company_subcategory", "subcategory", "companysubcategory"],
    "registered_address": ["registered_address", "address", "registered_office_address"],
    "email": ["email", "email_id", "company_email"],
    "pan": ["pan", "company_pan"],
}
REQUIRED_HEADERS = ["cin", "company_name", "status"]

# Date formats in the order in which they are tried.
DATE_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "dd-MMMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "dd.MM.yyyy"]

# Tokens that the name normalisations strip.
LIGHT_TOKENS = ["pvt", "ltd", "private", "limited", "india", "llp"]
STRICT_TOKENS = ["one person company", "corporation", "technologies", "enterprises", "enterprise", "industries", "solutions", "services", "private", "trading", "limited", "india", "corp", "tech", "pvt", "llp", "opc", "ltd", "co"]
CORE_TOKENS = ["pvt", "ltd", "private", "limited", "india", "llp", "opc", "corp", "corporation", "technologies", "technology", "tech", "enterprises", "enterprise", "industries", "industry", "solutions", "services", "trading", "exports", "imports", "infrastructure", "holdings", "group", "associates", "consultancy", "agency", "company", "co", "one person company"]
COMPANY_TOKENS = ["pvt", "private", "limited", "ltd", "llp", "opc", "corp", "corporation", "industries", "enterprise", "enterprises", "exports", "imports", "trading", "solutions", "services", "technologies", "infrastructure", "holdings", "group", "associates", "consultancy", "agency", "m/s", "bank", "finance", "financial", "insurance", "pharma", "pharmaceutical", "cement", "steel", "power", "energy", "telecom", "motors", "automotive", "chemicals", "textiles", "realty", "builders", "construction", "developers", "logistics", "shipping"]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Severity ladders, for watchlists and for subscribers (where ALERT becomes RED).
SEVERITY_RANK = {"INFO": 1, "WATCH": 2, "ALERT": 3, "CRITICAL": 4}
SUBSCRIBER_RANK = {"INFO": 0, "WATCH": 1, "AMBER": 2, "RED": 3, "ALERT": 3, "CRITICAL": 4}

# Case types and severities of legal events; others are WATCH.
CASE_SEVERITY = {"SARFAESI_13_2": "ALERT", "SARFAESI_13_4": "CRITICAL", "SARFAESI_AUCTION": "CRITICAL", "NCLT_7": "CRITICAL", "NCLT_9": "CRITICAL", "NCLT_10": "ALERT", "DRT": "ALERT", "SEC_138": "ALERT", "HIGH_COURT": "WATCH", "LABOUR": "WATCH"}

# Hours that alerts wait, by severity.
BATCH_HOURS = {"CRITICAL": 0, "ALERT": 4, "WATCH": 24, "INFO": 168}

# Role keywords and relevance tokens of texts.
ROLES = ["sales", "finance", "legal", "engineering", "hr", "operations"]
RELEVANT = ["enforcement", "cancellation of cor", "certificate of registration", "penalty", "restriction", "warning"]
BANK_TOKENS = ["bank", "financial", "asset reconstruction", "nbfc", "finance"]
PARTY_TOKENS = [" ltd", " limited", " pvt", " llp", " corp", " corporation"]

# Ordered substring rules (substring, event type, severity) and the default, by source and column.
NCLT_RULES = [("section 7", "NCLT_SEC7_FILED", "CRITICAL"), ("sec 7", "NCLT_SEC7_FILED", "CRITICAL"), ("s7", "NCLT_SEC7_FILED", "CRITICAL"), ("section 9", "NCLT_SEC9_FILED", "CRITICAL"), ("sec 9", "NCLT_SEC9_FILED", "CRITICAL"), ("s9", "NCLT_SEC9_FILED", "CRITICAL"), ("section 10", "NCLT_SEC10_FILED", "ALERT"), ("sec 10", "NCLT_SEC10_FILED", "ALERT"), ("s10", "NCLT_SEC10_FILED", "ALERT"), ("cirp admitted", "CIRP_ADMITTED", "CRITICAL"), ("admitted", "CIRP_ADMITTED", "CRITICAL"), ("liquidation ordered", "LIQUIDATION_ORDERED", "CRITICAL"), ("liquidation", "LIQUIDATION_ORDERED", "CRITICAL"), ("resolution approved", "RESOLUTION_APPROVED", "WATCH"), ("resolution plan", "RESOLUTION_APPROVED", "WATCH")]
SARFAESI_RULES = [("13(2)", "SARFAESI_DEMAND_NOTICE", "ALERT"), ("section 13(2)", "SARFAESI_DEMAND_NOTICE", "ALERT"), ("demand notice", "SARFAESI_DEMAND_NOTICE", "ALERT"), ("13(4)", "SARFAESI_POSSESSION_TAKEN", "CRITICAL"), ("section 13(4)", "SARFAESI_POSSESSION_TAKEN", "CRITICAL"), ("possession", "SARFAESI_POSSESSION_TAKEN", "CRITICAL"), ("auction scheduled", "SARFAESI_AUCTION_SCHEDULED", "CRITICAL"), ("auction notice", "SARFAESI_AUCTION_SCHEDULED", "CRITICAL"), ("auction completed", "SARFAESI_AUCTION_COMPLETED", "ALERT"), ("auction sold", "SARFAESI_AUCTION_COMPLETED", "ALERT")]
IBBI_TYPES = [("cirp", "IBBI_CIRP_ADMITTED", "CRITICAL"), ("liquidation", "IBBI_LIQUIDATION_ORDER", "CRITICAL"), ("voluntary liquidation", "IBBI_VOLUNTARY_LIQUIDATION", "ALERT"), ("resolution plan approved", "IBBI_RESOLUTION_APPROVED", "ALERT"), ("moratorium", "IBBI_MORATORIUM", "WATCH")]
#: source: (column, substring rules, default). An empty list is a constant.
SOURCE_RULES = {
    "nclt": ("filing_type", NCLT_RULES, ("NCLT_SEC7_FILED", "CRITICAL")),
    "drt": ("record_type", [("order", "DRT_ORDER_PASSED", "ALERT")], ("DRT_APPLICATION_FILED", "ALERT")),
    "sarfaesi": ("notice_stage", SARFAESI_RULES, ("SARFAESI_DEMAND_NOTICE", "ALERT")),
    "sebi_enforcement_orders": ("action", [], ("SEBI_ENFORCEMENT_ORDER", "CRITICAL")),
    "rbi_wilful_defaulter": ("action", [], ("RBI_WILFUL_DEFAULTER", "CRITICAL")),
    "rbi_nbfc_bank_notifications": ("action", [("cancel", "RBI_LICENSE_CANCELLED", "CRITICAL"), ("revok", "RBI_LICENSE_CANCELLED", "CRITICAL"), ("restrict", "RBI_REGULATORY_ACTION", "ALERT"), ("penalt", "RBI_REGULATORY_ACTION", "ALERT")], ("RBI_NOTIFICATION", "WATCH")),
    "gst_portal": ("gst_status", [("cancel", "GST_CANCELLED", "ALERT"), ("suspend", "GST_SUSPENDED", "ALERT")], ("GST_STATUS_CHANGE", "INFO")),
    "epfo": ("action", [], ("EPFO_COMPLIANCE_ISSUE", "WATCH")),
    "mca_charge_register": ("charge_status", [("creat", "MCA_CHARGE_CREATED", "WATCH"), ("modif", "MCA_CHARGE_MODIFIED", "WATCH"), ("satisf", "MCA_CHARGE_SATISFIED", "INFO")], ("MCA_CHARGE_FILED", "WATCH")),
    "high_court": ("action", [], ("HIGH_COURT_CASE", "ALERT")),
    "supreme_court": ("action", [], ("SUPREME_COURT_CASE", "CRITICAL")),
    "labour_court": ("action", [], ("LABOUR_COURT_ORDER", "WATCH")),
    "cci": ("action", [], ("CCI_FILING", "ALERT")),
    "dgft": ("action", [], ("DGFT_TRADE_NOTICE", "WATCH")),
    "rera": ("action", [], ("RERA_COMPLAINT", "ALERT")),
    "moef": ("action", [], ("MOEF_CLEARANCE", "WATCH")),
    "pollution_control_boards": ("action", [("closure", "POLLUTION_CONTROL_ACTION", "ALERT"), ("revok", "POLLUTION_CONTROL_ACTION", "ALERT")], ("POLLUTION_CONTROL_ACTION", "WATCH")),
    "cersai": ("action", [], ("CERSAI_SECURITY_INTEREST", "WATCH")),
    "state_vat_commercial_tax_portals": ("action", [], ("VAT_TAX_ACTION", "WATCH")),
    "udyam_registration_portal": ("action", [], ("UDYAM_REGISTRATION_CHANGE", "INFO")),
    "esic": ("action", [], ("ESIC_COMPLIANCE_ISSUE", "WATCH")),
    "gem": ("action", [("debar", "GEM_PROCUREMENT_EVENT", "CRITICAL"), ("blacklist", "GEM_PROCUREMENT_EVENT", "CRITICAL")], ("GEM_PROCUREMENT_EVENT", "WATCH")),
    "cppp": ("action", [], ("CPPP_TENDER_EVENT", "INFO")),
}
#: text classifiers: name: (ordered substring rules, default)
TEXT_RULES = {
    "regulator_order": ([("show cause", "SEBI_SHOW_CAUSE", "ALERT"), ("enquiry", "SEBI_SHOW_CAUSE", "ALERT"), ("interim", "SEBI_INTERIM_ORDER", "CRITICAL"), ("confirmatory", "SEBI_INTERIM_ORDER", "CRITICAL"), ("final", "SEBI_FINAL_ORDER", "ALERT"), ("settlement", "SEBI_SETTLEMENT", "WATCH")], ("SEBI_FINAL_ORDER", "ALERT")),
    "press_release": ([("cancellation", "RBI_LICENSE_CANCELLED", "CRITICAL"), ("certificate of registration", "RBI_LICENSE_CANCELLED", "CRITICAL"), ("restriction", "RBI_RESTRICTION", "ALERT"), ("warning", "RBI_WARNING", "WATCH")], ("RBI_ENFORCEMENT", "ALERT")),
    "competition": ([("approval", "CCI_MERGER_APPROVED", "INFO"), ("penalty", "CCI_PENALTY", "ALERT")], ("CCI_COMPLAINT", "WATCH")),
    "high_court": ([("attachment", "HIGH_COURT_ATTACHMENT", "CRITICAL"), ("injunction", "HIGH_COURT_INJUNCTION", "ALERT")], ("HIGH_COURT_COMMERCIAL_SUIT", "ALERT")),
    "supreme_court": ([("stay", "SC_STAY_GRANTED", "ALERT"), ("dismissed", "SC_APPEAL_DISMISSED", "ALERT")], ("SC_MATTER_LISTED", "WATCH")),
    "pollution": ([("closure", "CPCB_CLOSURE_ORDER", "CRITICAL"), ("revoked", "CTO_REVOKED", "CRITICAL")], ("POLLUTION_NOTICE", "WATCH")),
    "insolvency_board": ([("liquidation", "LIQUIDATION", "CRITICAL"), ("(liq", "LIQUIDATION", "CRITICAL"), ("resolution plan", "RESOLUTION PLAN", "ALERT"), ("cp(ib)", "CIRP", "CRITICAL"), ("ib-", "CIRP", "CRITICAL"), ("cirp", "CIRP", "CRITICAL")], ("OTHER", "ALERT")),
}
#: rules of the batch specs, for columns that hold an order type, a disclosure or a list's kind
BATCH_RULES = {
    "regulator_order_type": ([("debar", "SEBI_DEBARMENT", "CRITICAL"), ("investigation", "SEBI_INVESTIGATION", "WATCH"), ("director", "SEBI_DIRECTOR_ACTION", "ALERT"), ("penalty", "SEBI_PENALTY", "ALERT"), ("settlement", "SEBI_SETTLEMENT", "WATCH")], ("SEBI_FINAL_ORDER", "ALERT")),
    "promoter_disclosure": ([("pledge", "SEBI_PLEDGE_CREATED", "WATCH")], (None, None)),
    "vat_backfill": ([], ("VAT_HISTORICAL_DEFAULT", "WATCH")),
}
#: words that make a regulator's press release relevant
PRESS_RELEVANT = ["enforcement", "cancellation of cor", "certificate of registration", "penalty", "restriction", "warning"]
#: commercial suits fire only above this claim, in rupees
SUIT_CLAIM = 10_000_000
#: status transitions: source: ordered (previous statuses or None for any known, new status, event type, severity)
TRANSITIONS = {
    "gst": [(None, "cancelled", "GST_CANCELLED", "CRITICAL"), (None, "suspended", "GST_SUSPENDED", "ALERT"), (["cancelled", "suspended"], "active", "GST_RESTORED", "INFO")],
    "epfo": [(["active"], "inactive", "EPFO_COVERAGE_LAPSED", "ALERT")],
    "dgft": [(None, "cancelled", "IEC_CANCELLED", "ALERT"), (None, "surrendered", "IEC_SURRENDERED", "WATCH"), (None, "active", "IEC_NEW", "INFO")],
    "udyam": [(None, "cancelled", "UDYAM_CANCELLED", "WATCH")],
    "esic": [(None, "cancelled", "ESIC_CANCELLED", "ALERT"), (None, "default", "ESIC_DEFAULT", "WATCH")],
    "rera": [(None, "revoked", "RERA_REVOKED", "CRITICAL"), (None, "lapsed", "RERA_LAPSED", "ALERT")],
    "moef": [(None, "revoked", "EC_REVOKED", "CRITICAL"), (None, "refused", "EC_REFUSED", "ALERT"), (None, "granted", "EC_GRANTED", "INFO")],
}
#: first sight of a key: source: event type, severity
FIRST_SIGHT = {"esic": ("ESIC_NEW", "INFO"), "udyam": ("UDYAM_NEW", "INFO"), "rera": ("RERA_NEW_PROJECT", "INFO")}

# Composite rules: name: (severity, window in days, conditions); a condition lists event types, or a company field.
COMPOSITES = {
    "PRE_INSOLVENCY_CLASSIC": ("ALERT", 180, [["FILING_DECAY"], ["ECOURTS_SEC138", "ECOURTS_CIVIL"]]),
    "NPA_SEIZURE_IMMINENT": ("CRITICAL", 90, [["FILING_DECAY"], ["SARFAESI_DEMAND", "SARFAESI_POSSESSION"]]),
    "ZOMBIE_COMPANY": ("ALERT", 365, [["GST_CANCELLED"], {"status": "Active"}]),
    "OPERATIONAL_SHUTDOWN": ("CRITICAL", 90, [["EPFO_CONTRIBUTION_DROP"], ["GEM_HIRING_FREEZE"], ["FILING_DECAY"]]),
    "GOVERNANCE_COLLAPSE": ("CRITICAL", 180, [["AUDITOR_CHANGED"], ["CFO_RESIGNED"], ["FILING_DECAY"]]),
    "CONTAGION_BAD_ACTOR": ("ALERT", 0, [["WILFUL_DEFAULT_DIRECTOR"]]),
    "PROMOTER_EXIT_BANK_SEIZURE": ("CRITICAL", 90, [["SEBI_BULK_DEAL_PROMOTER_SELL"], ["SARFAESI_DEMAND", "SARFAESI_POSSESSION"]]),
    "FUNDED_GROWTH": ("INFO", 180, [["CAPITAL_INCREASE"], ["EPFO_HIRING_SURGE"], ["GEM_ORDER_WON"]]),
    # only in the matrix of the documents, which gives no window; the director of a red company is o11_contagious_directors
    "UNSTABLE_GROWTH": ("WATCH", 180, [["CAPITAL_INCREASE"], ["DIRECTOR_RESIGNED", "CFO_RESIGNED"]]),
    "NEW_MSME_SELLER": ("INFO", 180, [["NEW_COMPANY"], ["UDYAM_NEW"], ["GEM_NEW_SELLER"]]),
    "HEALTHY_TRADER": ("INFO", 180, [["IEC_NEW"], ["GST_RESTORED"], ["EPFO_HIRING_SURGE"]]),
    "MAJOR_EXPANSION": ("INFO", 180, [["CCI_MERGER_APPROVED"], ["CAPITAL_INCREASE"]]),
    "PROJECT_GREENLIGHTED": ("INFO", 180, [["EC_GRANTED", "MOEF_CLEARANCE"], ["CPPP_TENDER_EVENT"]]),
    "WORKFORCE_REDUCTION": ("ALERT", 180, [["LABOUR_MASS_RETRENCHMENT"], ["EPFO_CONTRIBUTION_DROP"]]),
}
#: emitted event types that stand for the names in the composite rules
EVENT_ALIASES = {"AGM_OVERDUE": "FILING_DECAY", "SEC138_FILED": "ECOURTS_SEC138", "SEC138_MULTIPLE": "ECOURTS_SEC138", "CIVIL_SUIT_FILED": "ECOURTS_CIVIL", "SARFAESI_DEMAND_NOTICE": "SARFAESI_DEMAND", "SARFAESI_POSSESSION_TAKEN": "SARFAESI_POSSESSION", "HIRING_FREEZE_SIGNAL": "GEM_HIRING_FREEZE"}

# Weights of the health components and the penalties of peers.
WEIGHTS = {"filing_freshness": 0.25, "director_stability": 0.20, "legal_risk": 0.25, "financial_health": 0.20, "capital_trajectory": 0.10}
PEER_PENALTY = {"RED": 15, "AMBER": 5}
PRIORITY_CASES = ["NCLT_7", "NCLT_9", "NCLT_10", "SARFAESI_13_4", "SARFAESI_AUCTION"]
