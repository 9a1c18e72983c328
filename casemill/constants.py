"""Fixed values of the domain.

Everything in this file must equal the published behaviour for results to
match: thresholds, vocabularies and text patterns.  Patterns are kept in one
place, in natural order, and are written without look-around so that Java and
RE2 engines read them alike.
"""

# Risk tiers, closed lower bounds on the detector probability.
TIER_HIGH = "ALTO"
TIER_MEDIUM = "MEDIO"
TIER_LOW = "BAJO"
HIGH_FROM = 0.80
MEDIUM_FROM = 0.40

# Case selection.
CASES_MIN = 3
CASES_MAX = 10

# Split and sampling.
SEED = 42
TEST_SHARE = 0.2
TOP_N = (50, 100, 200)
COMPARE_N = (20, 50, 100, 200)
SMOTE_NEIGHBOURS = 5

# Cost model of the continuous regime.
FIXED_TASKS = 2
SECONDS_PER_TASK = 6.8
AGENT_LIMIT_SECONDS = 180
SHORT_OUTPUT_CHARS = 50

# Expected size of the card data set.
EXPECTED_ROWS = 284_807
EXPECTED_POSITIVES = 492

PCA_COLS = [f"V{i}" for i in range(1, 29)]
FEATURE_COLS = PCA_COLS + ["Amount", "Hour"]

# Authority modes, information levels, verdicts and labels.
MODE_INTERPRET = "interpreta"
MODE_REVIEW = "revisa"
LEVELS = ("completo", "sin_nivel", "ciego")
CONFIRMED = "CONFIRMADO"
DISMISSED = "DESCARTADO"
NO_VERDICT = "SIN VEREDICTO"

AUDIT_INVENTED_IDS = "NO FIABLE - identificadores inventados"
AUDIT_INVENTED_CONCEPTS = "NO FIABLE - invencion semantica"
AUDIT_INCOMPLETE = "INCOMPLETO"
AUDIT_RELIABLE = "FIABLE"

EARTH_RADIUS_KM = 6371.0

# Contexts in which a number is a cited id (one capture group each).
ID_PATTERNS = [
    r"CASO\s*#?\s*\**\s*(\d{1,6})",
    r"CASE\s*#?\s*\**\s*(\d{1,6})",
    r"[Tt]ransacci[óo]n\s*(?:ID)?\s*[:#]?\s*\**\s*(\d{1,6})",
    r"[Tt]ransaction\s*(?:ID)?\s*[:#]?\s*\**\s*(\d{1,6})",
    r"\bID\s*[:=]?\s*\**\s*(\d{1,6})",
    r"^\s*\|\s*\**\s*(\d{1,6})\s*\**\s*\|",
]

# Literal parts without which the pattern at the same place cannot match.
ID_STEMS = ["CASO", "CASE", "ransacci", "ransaction", "ID", "|"]

# Case header up to its first verdict: group 1 is the case, group 3 the word.
VERDICT_PATTERN = (
    r"CAS[OE]\s+(\d+)(.*?)(?:VEREDICTO|VERDICT):\s*"
    r"(CONFIRMADO|DESCARTADO|CONFIRMED|DISCARDED|DISMISSED)"
)
VERDICT_TRANSLATION = {
    "CONFIRMED": CONFIRMED,
    "DISCARDED": DISMISSED,
    "DISMISSED": DISMISSED,
}
VERDICT_END_PATTERN = (
    r"(?:VEREDICTO|VERDICT):\s*"
    r"(?:CONFIRMADO|DESCARTADO|CONFIRMED|DISCARDED|DISMISSED)"
)
VERDICT_MARK_PATTERN = r"(?:VEREDICTO|VERDICT)\s*:"
VERDICT_CUT_PATTERN = r"(?:VEREDICTO|VERDICT):"
SINGLE_VERDICT_PATTERN = r"VEREDICTO:\s*(CONFIRMADO|DESCARTADO)"

# A concept is not invented when it is denied within this many characters.
NEGATION_WINDOW = 120
NEGATION_PATTERN = (
    r"(sin\s+(acceso|informaci[óo]n|datos|mencionar|citar|incluir|considerar|"
    r"referencias?|hacer|conocer|disponer|atender|recurrir|apelar)|"
    r"(falta|ausencia|carencia)\s+de|carece[nr]?\s+de|"
    r"no\s+(se\s+)?(dispone|dispongo|disponemos|tiene|tenemos|cuenta\s+con|"
    r"menciona|incluye|cita|hay|existen?|contiene|consta)|"
    r"ning[úu]n[ao]?|tampoco|ni\s|"
    r"without\s+(access|information|data|mentioning|citing|considering)|"
    r"(lack|absence)\s+of|no\s+(access|information|data|history|record)|"
    r"there\s+is\s+no|not\s+available|unavailable|cannot\s+(access|determine))"
)

# Concepts the data cannot contain; the second field is a topic code.
CONCEPT_RULES = [
    (r"\bpa[ií]s(es)?\b", "geography"),
    (r"\bubicaci[óo]n|\bgeolocalizaci[óo]n", "location"),
    (r"\bcomercio|\bestablecimiento|\bcomerciante", "merchant"),
    (
        r"(datos|nombre|edad|direcci[óo]n|perfil|dni) del titular|"
        r"titular\s+(se\s+llama|es\s+un|reside|vive)",
        "holder",
    ),
    (r"n[úu]mero de (cuenta|tarjeta)|cuenta (bancaria|del cliente)", "account"),
    (r"historial (de[l]? )?(cliente|actividad|transacciones|compras)", "history"),
    (r"transacciones (anteriores|previas|recientes)", "related"),
    (r"corto per[íi]odo|pocos minutos|en cuesti[óo]n de (minutos|segundos)", "frequency"),
    (r"\bcountr(y|ies)\b", "geography"),
    (r"\blocation\b|\bgeolocation\b", "location"),
    (r"\bmerchant\b|\bstore\b|\bvendor\b", "merchant"),
    (
        r"(name|age|address|profile|identity) of the (holder|cardholder|customer)|"
        r"cardholder\s+(is|lives|resides)",
        "holder",
    ),
    (r"(account|card) number|bank account", "account"),
    (
        r"(customer|transaction|purchase|spending)\s+history|"
        r"history of (the )?(customer|transactions)",
        "history",
    ),
    (r"(previous|prior|earlier|recent)\s+transactions", "related"),
    (r"within (a few|minutes|seconds)|short (time )?(period|window)", "frequency"),
]

# Literal parts of the rules above, in their order: a match holds one of its rule's parts,
# so a text without any of them needs no pattern search.
CONCEPT_STEMS = [
    ("pais", "país"),
    ("ubicaci", "geolocalizaci"),
    ("comercio", "establecimiento", "comerciante"),
    ("titular",),
    ("mero de", "cuenta "),
    ("historial ",),
    ("transacciones ",),
    ("corto per", "pocos minutos", "en cuesti"),
    ("countr",),
    ("location",),
    ("merchant", "store", "vendor"),
    ("holder", "customer"),
    ("card number", "account number", "bank account"),
    ("history",),
    ("transactions",),
    ("within ", "short "),
]

# Words that mark a language, for the language drift of a report.
SPANISH_WORDS = [
    "que", "de", "la", "el", "los", "las", "una", "por", "con", "para", "como", "este", "esta", "se", "es", "son",
    "transacción", "transaccion", "importe", "riesgo", "fraude", "caso",
]
ENGLISH_WORDS = [
    "the", "and", "is", "are", "of", "to", "with", "for", "this", "that", "was", "were", "amount",
    "transaction", "risk", "fraud", "case", "suspicious",
]

# The two families of the "test charge, then a larger one" pattern.
PROBE_PATTERN = (
    r"\b(prueba|probar|tante|verificaci[oó]n|verificar|comprobar|"
    r"preliminar(es)?|inicial(es)?|test(eo|ear)?)\b"
)
LATER_CHARGE_PATTERN = (
    r"(cargo|transacci[oó]n|compra|importe)s?\s+(m[aá]s\s+)?"
    r"(grande|mayor|elevad|alt)|"
    r"antes\s+de\s+(realizar|efectuar|un|una)|"
    r"posterior(es|mente)?|"
    r"despu[eé]s\s+(de|realic|har)"
)

# Hyper-parameter search space and its base configuration.
SEARCH_BASE = {
    "n_estimators": 400,
    "max_depth": 5,
    "learning_rate": 0.1,
    "subsample": 0.8,
    "colsample": 0.8,
}
SEARCH_SPACE = {
    "n_estimators": [100, 200, 400, 600, 800],
    "max_depth": [3, 4, 5, 6, 8, 10],
    "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2, 0.3],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "colsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "min_child_weight": [1, 3, 5, 10],
    "gamma": [0, 0.1, 0.3, 0.5, 1.0],
}

# Feature groups of the variable ablation: what each group leaves out.
FEATURE_GROUPS = {
    "full": FEATURE_COLS,
    "without_hour": PCA_COLS + ["Amount"],
    "without_amount": PCA_COLS + ["Hour"],
    "pca_only": PCA_COLS,
}
ABLATION_TOLERANCE = 0.005
