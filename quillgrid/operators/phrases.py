"""Phrases and labels of the rules.

All lists here are fixed values: results depend on them word for word. The
topic lexicon itself (over a thousand terms) is data, see ``lexicon.Taxonomy``.
"""

COMMON_ANCHORS = (
    "urban renewal", "urban regeneration", "urban redevelopment", "urban transformation", "urban revitalization", "city regeneration", "district regeneration", "area regeneration", "redevelopment", "regeneration", "renewal", "revitalization", "upgrading", "rehabilitation", "adaptive reuse",
    "brownfield redevelopment", "brownfield regeneration", "community renewal", "estate regeneration", "old city renewal", "old town renewal", "old district renewal", "urban village redevelopment", "slum upgrading", "public space renewal", "street renewal", "station area renewal",
)
CORE_ANCHORS = ("urban renewal", "urban regeneration", "urban redevelopment", "urban revitalization", "brownfield redevelopment", "brownfield regeneration", "slum upgrading", "informal settlement upgrading", "adaptive reuse")
EXISTING_OBJECTS = (
    "old neighborhood", "old neighbourhood", "old community", "old district", "old town", "old city", "inner city", "inner-city", "city centre", "city center", "historic district", "historic quarter", "brownfield", "industrial site", "urban village", "housing estate", "public housing estate", "waterfront",
    "station area",
)
RURAL_ANCHORS = ("rural", "agricultural", "farmland", "countryside", "fishing village", "fishing community", "village revitalization")
PENALTY_MECHANISMS = ("compensation", "relocation", "resettlement", "tif", "ppp", "reit", "land value capture")

MISUSE_TRIGGER = ("urban renewal",)
MISUSE_MATH = ("dimer", "bipartite graph", "teichmuller", "cluster algebra", "tiling", "combinatorics")
RURAL = ("rural regeneration", "rural renewal", "rural gentrification", "village revitalization", "agricultural regeneration", "rural development", "fishing community")
GREENFIELD = ("new town", "greenfield", "urban expansion", "sprawl", "urban fringe", "suburban growth")
METHOD = ("algorithm", "deep learning", "machine learning", "cnn", "optimization", "framework", "numerical simulation")
MATERIALS = ("recycled concrete", "compressive strength", "cement", "hydration", "soil contamination", "pollution", "thermal storage", "wastewater treatment")
BACKGROUND = ("in the context of urban renewal", "support for urban renewal", "renewal area", "for future renewal planning", "plays a role in regeneration", "background context", "general background context", "broad application context", "application context", "general context")
MEDIA = ("discourse", "representation", "photography", "memory", "cinema", "era of urban renewal", "media coverage")
WORDING = ("urban renewal", "urban regeneration", "urban redevelopment", "redevelopment", "regeneration", "renewal", "revitalization")
GOVERNANCE = ("governance", "policy", "law", "program", "programme", "institution", "city governance", "local governance")
GENERAL_METHOD = ("framework", "model", "algorithm", "machine learning", "deep learning", "remote sensing", "gis", "assessment", "evaluation", "design")
MECHANISMS = (
    "tax increment financing", "tif", "ppp", "public private partnership", "reit", "land value capture", "compensation", "relocation", "resettlement", "demolition", "adaptive reuse", "slum upgrading", "urban village", "brownfield", "historic district", "historic quarter", "station area", "public space renewal",
    "street renewal",
)
NEGATIVE_DOMAINS = ("mechanics", "geochemistry & geophysics", "materials science", "physics, applied", "engineering, electrical & electronic")
RELATED_DOMAINS = (
    "urban studies", "regional & urban planning", "geography", "development studies", "public administration", "architecture", "sociology", "political science", "history", "anthropology", "economics", "government & law", "construction & building technology", "engineering, civil",
    "green & sustainable science & technology", "environmental studies", "social sciences, interdisciplinary", "public, environmental & occupational health", "transportation", "management", "area studies",
)
NEGATIVE_KEYWORDS = ("mechanical properties", "recycled concrete", "compressive strength", "pollution", "soil contamination")

BACKGROUND_RISK, MEDIA_RISK, GREENFIELD_RISK, TECHNICAL_RISK, OTHER_OBJECT_RISK = "background_support_risk", "social_history_media_risk", "greenfield_expansion_risk", "generic_technical_risk", "explicit_renewal_wording_but_other_object"
RISK_ADJUSTMENTS = {TECHNICAL_RISK: -0.06, BACKGROUND_RISK: -0.08, MEDIA_RISK: -0.06, GREENFIELD_RISK: -0.12, OTHER_OBJECT_RISK: 0.03}

NEGATIONS = (
    "without renewal", "without any renewal", "without urban renewal", "without regeneration", "without redevelopment", "no renewal", "no urban renewal", "no regeneration", "no redevelopment", "not renewal", "not regeneration", "not redevelopment", "without intervention", "without intervention evidence",
    "without project evidence", "without redevelopment intervention", "without renewal intervention",
)
CONTEXT = (
    "urban", "city", "cities", "municipal", "metropolitan", "neighborhood", "neighbourhood", "downtown", "inner city", "inner-city", "slum", "informal settlement", "brownfield", "housing estate", "public housing", "old town", "old district", "local government", "planning", "housing", "land use", "infrastructure",
    "community",
)
ACTIONS = ("renewal", "regeneration", "redevelopment", "revitalization", "upgrading", "rehabilitation", "renovation", "adaptive reuse", "retrofit", "retrofitting", "requalification")
BUILT = (
    *EXISTING_OBJECTS, "existing district", "existing districts", "existing neighborhood", "existing neighbourhood", "existing community", "existing communities", "existing building", "existing buildings", "old building", "old buildings", "building stock", "historic urban fabric", "urban fabric",
    "built environment", "aging district", "ageing district", "older district", "older neighborhood", "older neighbourhood",
)
POLICY = ("policy", "program", "programme", "project", "strategy", "intervention", "initiative", "scheme", "plan", "planning", "implementation")
PROMOTION_BLOCKS = ("rural", "agricultur", "farmland", "peri-urban", "periurban", "counter-urbanisation", "counter-urbanization")
BROWNFIELD_BLOCKS = ("agricultural premises", "rural spaces", "rural space", "derelict agricultural")
RECOVERY_BLOCKS = ("tenure security", "leaking underground storage tank", "leaking underground storage tanks")
HARD_NEGATIVES = ("math_term_misuse", "rural_nonurban")

#: Unknown topics: (rule, local) -> confidence and margin of the local label that overrule the rule.
RULE_TO_LOCAL = {
    ("N3", "U9"): (0.68, 1.0), ("N4", "U9"): (0.7, 1.1), ("N8", "U9"): (0.68, 1.0), ("N3", "U12"): (0.68, 1.0), ("N4", "U12"): (0.64, 0.2), ("N1", "U12"): (0.62, 0.2), ("N2", "U12"): (0.62, 0.2), ("N5", "U12"): (0.64, 0.2), ("N7", "U12"): (0.62, 0.2), ("N9", "U12"): (0.62, 0.2),
    ("N3", "U1"): (0.68, 0.8), ("N4", "U1"): (0.60, 0.0), ("N8", "U1"): (0.60, 0.0), ("N4", "U4"): (0.64, 0.2), ("N2", "U5"): (0.62, 0.0), ("N9", "U5"): (0.62, 0.0), ("N10", "U5"): (0.64, 0.2), ("N3", "U10"): (0.7, 1.0), ("N4", "U10"): (0.7, 1.0),
}
#: (rule, local) -> confidence of the rule that overrules the local label.
RULE_TO_TOPIC = {
    ("U12", "N4"): 0.30, ("U12", "N1"): 0.30, ("U12", "N2"): 0.3, ("U12", "N5"): 0.32, ("U12", "N7"): 0.32, ("U12", "N9"): 0.32, ("U1", "N1"): 0.28, ("U9", "N3"): 0.65, ("U10", "N3"): 0.68, ("U10", "N4"): 0.68, ("U4", "N1"): 0.28, ("U4", "N4"): 0.32, ("U5", "N2"): 0.3, ("U5", "N9"): 0.3, ("U5", "N10"): 0.32,
}
WEAK_RULES = {"U1": 0.28, "U3": 0.28, "U11": 0.28, "U4": 0.3, "U5": 0.3, "U9": 0.4, "U10": 0.45, "U12": 0.32, "U15": 0.35}
#: (rule, local) -> confidence, margin and probability of the local label, without hints.
OFFLINE_LOCAL = {("N8", "U9"): (0.84, 2.5, 0.0), ("N3", "U9"): (0.89, 3.0, 0.0), ("N3", "U12"): (0.85, 4.5, 0.0), ("N3", "U1"): (0.67, 1.0, 0.92), ("N4", "U1"): (0.67, 1.0, 0.92)}
#: Floors for a topic to stay known: score, margin, probability from which a label out of scope is doubted, or up to which one in scope is, below a score.
UNKNOWN_POLICIES = {
    "N2": (2.85, 1.25, 0.53, None, None), "N3": (2.9, 1.35, 0.53, None, None), "N4": (2.9, 1.35, 0.55, None, None), "N8": (2.85, 1.25, 0.53, None, None), "U3": (2.8, 1.15, None, 0.56, 5.5), "U10": (2.95, 1.2, None, 0.58, 5.5), "U14": (2.85, 1.15, None, 0.57, 5.5), "U15": (2.95, 1.2, None, 0.58, 5.5),
}
#: Boundary between families: labels in scope, labels out of scope, name.
BOUNDARIES = ((("U9", "U10"), ("N3", "N4", "N8"), "governance_policy_finance_boundary"), (("U12", "U15", "U3"), ("N4", "N5", "N7", "N9"), "social_impact_boundary"), (("U5",), ("N2", "N9", "N10"), "brownfield_environment_boundary"))
HIGH_RISK_RULES = ("N1", "N3", "N4", "N5", "N7", "N9", "N10")
GUARD_BUCKETS = ("nonurban_rule_urban_local", "governance_policy_finance_boundary", "brownfield_environment_boundary")
PROMOTE_BUCKETS = GUARD_BUCKETS[:2]
#: Signals of curated rules for unknown topics.
U1_SIGNALS = ("anchor:urban renewal", "anchor:urban regeneration", "anchor:district regeneration", "anchor:redevelopment", "anchor:renewal", "anchor:upgrading")
U9_SIGNALS = ("combo:urban regeneration+policy", "combo:urban regeneration+participation", "combo:urban regeneration+governance", "combo:urban renewal+governance")
U10_SIGNALS = ("anchor:urban regeneration", "anchor:urban redevelopment", "anchor:redevelopment")
#: Keywords of a cluster that make it a candidate in scope, or out of scope.
CLUSTER_ANCHORS = (
    "renewal", "regeneration", "redevelopment", "revitalization", "brownfield", "adaptive_reuse", "slum", "rehabilitation", "retrofit", "urban_village", "old_community", "old_neighborhood", "old_neighbourhood", "old_district", "old_town", "public_space_renewal", "street_renewal", "estate_regeneration",
)
CLUSTER_OUT = ("rural", "agriculture", "transport", "mobility", "algorithm", "model", "simulation", "pollution", "ecology", "tourism")
