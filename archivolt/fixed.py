"""Fixed values.  Results depend on these exact lists, numbers and formats."""

# --- chunking and retrieval parameters -------------------------------------
CHUNK_SIZE = 500
CHUNK_OVERLAP = 100
MIN_CHUNK_CHARS = 20          # a chunk is kept when longer than this
MIN_DOCUMENT_CHARS = 50       # a stripped document shorter than this gets no chunks
NAMED_CHAPTERS = 5   # as many as an exam looks at; a chat looks at three
CHAPTER_HEAD_CHARS = 500
LARGE_TEXT_CHARS = 80000
N_RESULTS = 5
HYBRID_RESULTS = 15
HYBRID_THRESHOLD = 200
MIN_KEYWORD_CHARS = 3

# --- library scan ----------------------------------------------------------
INDEX_EXTENSIONS = [".md", ".pdf", ".txt", ".docx", ".pptx"]
IGNORED_DIRS = ["__pycache__", "temp_ingestion", "temp_local_ingestion"]
MANIFEST_SCHEMA_VERSION = 1

# --- history ---------------------------------------------------------------
HISTORY_PAIRS = 5
HISTORY_ANSWER_CHARS = 300
REFLECTION_PAIRS = 10
REFLECTION_ANSWER_CHARS = 200
ANALYSIS_INTERVAL = 5
ANALYSIS_MIN_ANSWER = 50

# --- chapter words, tried in this order ------------------------------------
CHAPTER_WORDS = ["cap[íi]tulo", "t[íi]tulo", "secci[óo]n"]
CHAPTER_STEMS = ["tulo", "secci"]   # every chapter word holds one of these in lower case
ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

# --- phrases that mark a prompt-injection attempt --------------------------
INJECTION_PHRASES = [
    "ignore previous", "ignore all", "ignore instructions", "system:", "override",
    "you are now", "forget everything", "new instructions", "act as", "pretend you are",
    "jailbreak", "do anything now", "dan mode", "developer mode", "bypass", "hack",
    "exploit",
]

# --- words that mark a secret key ------------------------------------------
SECRET_MARKERS = ["key", "token", "secret", "password", "authorization"]
URL_CREDENTIALS = r"(?i)(https?://)[^/@\s]+@"
BEARER_TOKEN = r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+"

# --- question topics, first match wins -------------------------------------
QUESTION_TOPICS = [
    ("estadística", ["estadística", "covarianza", "muestreo", "probabilidad"]),
    ("derecho", ["derecho", "constitución", "ley", "bidart"]),
    ("programación", ["código", "python", "programar", "función"]),
    ("finanzas", ["bitcoin", "ethereum", "comprar", "vender", "usdt"]),
    ("emociones", ["triste", "estresado", "ansioso", "feliz", "orgulloso"]),
]
OTHER_TOPIC = "general"

# --- suggestions: topic, count that must be exceeded, text ------------------
SUGGESTIONS = [
    ("estadística", 3, "📊 El usuario pregunta mucho sobre estadística. Considerá indexar más material de esa área."),
    ("derecho", 3, "⚖️ Hay muchas consultas sobre derecho. Verificá que el RAG tenga los capítulos clave de Bidart y Sagues."),
    ("finanzas", 2, "📈 Optimizar el sistema de búsqueda semántica para mejorar la precisión en documentos largos."),
    ("emociones", 2, "💭 El usuario comparte emociones regularmente. El agente psicólogo es importante para él."),
]
NO_SUGGESTION = "✅ No se detectaron patrones críticos. El sistema está funcionando bien."

# --- diary categories, first match wins ------------------------------------
DIARY_CATEGORIES = [
    ("logro", ["orgulloso", "aprobé", "logré", "bien", "éxito", "feliz", "terminé"]),
    ("emocion", ["triste", "mal", "ansioso", "estresado", "cansado"]),
    ("proyecto", ["proyecto", "código"]),
    ("reflexion", ["pensé", "reflexion", "idea"]),
]
DIARY_DEFAULT = "general"

# --- rule phrases ----------------------------------------------------------
RULE_ASK = "si te pregunto por"
RULE_ANSWER = ["responde", "respondé"]
RULE_ALWAYS = ["responde siempre", "siempre responde"]
RULE_FORMAT = [
    "responde con", "responde en", "máximo", "minimo",
    "palabras", "caracteres", "oraciones", "párrafos",
]

# --- routing labels --------------------------------------------------------
ROUTE_LABELS = ["general", "estadistica", "researcher", "mentor", "arquitecto"]
DEFAULT_ROUTE = "general"

# --- memory ----------------------------------------------------------------
MEMORY_CATEGORIES = [
    "Perfil", "Aprendizajes", "Decisiones", "Universidad",
    "Proyectos", "Diario", "Salud", "Finanzas",
]
DIGEST_PART_FAILED = "⚠️ Error procesando parte"
DIGEST_FAILED = "❌ Error en digestión"
MEMORY_DEFAULT_REASON = "Información relevante sobre el usuario"

# --- keyword extraction ----------------------------------------------------
STOP_WORDS = [
    "de", "la", "el", "en", "un", "una", "del", "los", "las", "con", "por", "para",
    "y", "e", "o", "a", "al", "que", "es", "se", "su", "lo", "como", "más", "entre",
    "según", "todo", "este", "esta", "esto", "clase", "tema", "capítulo", "material",
]

# --- web policy ------------------------------------------------------------
URL_SKIP_FRAGMENTS = [
    "/search?", "/graphs/", "/blob/", "/tree/", "/pulse/",
    "/issues/", "/pull/", "/projects/", "/wiki/", "/settings",
    "/actions", "/discussions", "/releases/tag",
]
URL_SKIP_EXTENSIONS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg",
    ".zip", ".rar", ".7z", ".exe", ".msi", ".dmg", ".iso",
    ".mp3", ".mp4", ".avi", ".mov", ".woff", ".woff2",
]
TRUSTED_SUFFIXES = [
    ".gob.ar", ".edu.ar", ".gov", ".edu", ".org",
    "infojus.gob.ar", "diputados.gob.ar", "senado.gob.ar",
    "boletinoficial.gob.ar", "unlp.edu.ar", "uba.ar",
]
HTML_SKIP_TAGS = ["script", "style", "nav", "footer", "header", "noscript"]
HTML_HIDDEN_TAGS = ["script", "style"]
CRAWL_CONTENT_TYPES = ["text/html", "application/xhtml+xml", "text/plain"]
INGEST_CONTENT_TYPES = ["application/pdf", "text/html", "text/plain", "application/octet-stream"]
CRAWL_MAX_BYTES = 5 * 1024 * 1024
INGEST_MAX_BYTES = 50 * 1024 * 1024
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL"] + [f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]
MIN_PAGE_WORDS = 40
MIN_LONG_WORDS = 5
LONG_WORD_CHARS = 5
CRAWL_DEPTH = 3
CRAWL_QUEUE = 500
CRAWL_PAGES = 20
CRAWL_REQUESTS_PER_PAGE = 10

# --- text extraction routing -----------------------------------------------
PAGE_TEXT_CHARS = 50
DIRECT_PAGE_SHARE = 0.3
OCR_MAX_PAGES = 600

# --- model input cuts ------------------------------------------------------
THEME_CHARS = 2000
NOTES_CHARS = 5000
EXAM_CONTEXT_CHARS = 18000
EXAM_MIN_CONTEXT = 200
MEMORY_ANSWER_CHARS = 300

# --- exam ------------------------------------------------------------------
EXAM_DEFAULT_TOTAL = 10
EXAM_COUNTS = {   # what a request counts, by kind; the first number in it is the count
    "concept": r"(\d+)\s*(?:preguntas?\s*(?:de\s*)?)?conceptuales?",
    "essay": r"(\d+)\s*(?:preguntas?\s*(?:de\s*)?)?desarrollo",
    "truth": r"(\d+)\s*(?:preguntas?\s*(?:de\s*)?)?(?:verdadero\s*(?:y|o)\s*falso|v\s*(?:y|o)?\s*f)",
    "total": r"(\d+)\s*preguntas?",
}
EXAM_KIND = r"\[(CONCEPTUAL|DESARROLLO|V/F|VF|VERDADERO/FALSO)\]"
EXAM_TRUTH_KINDS = ["V/F", "VF", "VERDADERO/FALSO"]
EXAM_HEADING = "PREGUNTA"
EXAM_NUMBER = r"PREGUNTA\s*(?:N[°º:]?\s*)?(\d+)"
EXAM_POINTS = r"PUNTAJE\s*:\s*(\d+)"
EXAM_FEEDBACK = r"FEEDBACK\s*:\s*(.+)"
EXAM_LABELS = ["ENUNCIADO", "OPCIONES", "RESPUESTA", "JUSTIFICACION", "CRITERIOS", "PUNTAJE"]
# Fixed patterns: what a request says besides its material, cut in this order.
EXAM_REQUEST_PARTS = [
    r"^(hazme|dame|quiero|necesito|genera|crea|hacé|da)\s*\d*\s*preguntas?\s*(de|sobre|del)?\s*",
    r",?\s*\d+\s*preguntas?\s*(?:aleatori[ao]s?)?\s*,?\s*",
    r",?\s*\d+\s*(?:conceptuales|desarrollo|verdadero\s*y?\s*falso|v/?f).*",
    r"\b(cap[íi]tulo\s*\d+(\s*(al|a|y|hasta)\s*\d+)?)\b",
    r"\s*,\s*$",
]
EXAM_PASS_SHARE = 0.7
EXAM_NO_ANSWER = "No especificada"
EXAM_DEFAULT_CRITERIA = "Evaluar precisión conceptual y completitud"
EXAM_UNPARSED = "El modelo no pudo generar preguntas estructuradas."
EXAM_NO_FEEDBACK = "Sin feedback."
EXAM_BANDS = [
    (80, "✅ Excelente desempeño."),
    (60, "⚠️ Buen nivel, repasá los puntos débiles."),
    (0, "🔴 Repaso intensivo necesario."),
]

# Characters that count as blank at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
