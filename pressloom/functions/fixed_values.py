"""Everything here must equal the published behaviour for results to match.

Nothing in this module is logic. Patterns are written so that the same text means the same thing to
Java's regex engine, Python's ``re`` and RE2.
"""

# --- article layout -------------------------------------------------------------------------------
SOURCE_COLUMNS = ["Date", "Headline", "Description", "Covid Status", "Image URL", "Source", "Sentiment"]
TEXT_COLUMNS = ["headline", "description"]
OPTIONAL_DEFAULTS = {
    "covid_status": "unknown",
    "sentiment": "neutral",
    "source": "",
    "image": "",
    "image_url": "",
}

# --- CSV null tokens (the default set of the pandas CSV reader) --------------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- date formats tried in this order -------------------------------------------------------------
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm[:ss][.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][.SSS][XXX]", "yyyy/M/d[ HH:mm:ss]",
    "dd/MM/yyyy", "M/d/yyyy", "d/M/yyyy", "d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy",
]

# --- dates of a column whose convention is inferred ------------------------------------------------
# Two numbers and a year, the same separator between them; what follows is the time of day.
NUMERIC_DATE = r"^\s*(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})(?!\d)(.*)$"
WEEKDAY = r"^\s*[A-Za-z]{3,9},\s+"
ZONE_NAME = r"\s(GMT|UTC|UT|Z)\s*$"
PLAIN_FORMATS = [
    "yyyy-M-d", "yyyy-M-d HH:mm[:ss][.SSSSSS][.SSS]", "yyyy-M-d'T'HH:mm[:ss][.SSSSSS][.SSS][XXX]", "yyyyMMdd",
    "yyyy/M/d[ HH:mm:ss]", "d MMM yyyy[ HH:mm[:ss][ xx]]", "d MMMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy",
]

# --- cleaning patterns ----------------------------------------------------------------------------
# Python's Unicode white space, spelt out because neither Java's nor RE2's \s covers it.
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WHITESPACE = WHITESPACE.replace("[", "[^", 1)
HTML_TAG = r"<[^>]+>"
HTML_ENTITY = r"&[a-z]+;|&#\p{Nd}+;"  # case-insensitive
SPECIAL_CHAR = r"[^0-9A-Za-z_\t-\r\x1c-\x20.,!?'\-]"  # applied to ASCII text
# The same, spelt out: Java looks single characters up in one table, a chain of ranges took it 20 times as long.
SPECIAL_CHAR_SPELT = (
    "[^0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    r"_\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20.,!?'\-]"
)
NON_ASCII = r"[^\x00-\x7f]"

# --- split ratios ---------------------------------------------------------------------------------
TRAIN_RATIO = 0.70
VAL_RATIO = 0.15

# --- TF-IDF, SVD, topics --------------------------------------------------------------------------
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"
MAX_FEATURES = 5000
MIN_DF = 2
MAX_DF = 0.95
TOP_KEYWORDS = 5
SVD_COMPONENTS = 100
SEED = 42
N_CLUSTERS = 8
KMEANS_RESTARTS = 10
TOP_TERMS_PER_CLUSTER = 5

# English stop words: Spark's ``StopWordsRemover.loadDefaultStopWords("english")`` without the entries
# that the token pattern can never produce (apostrophes, single letters). Any other list can be passed in.
ENGLISH_STOP_WORDS = """
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is
are was were be been being have has had having do does did doing an the and but if or because as until
while of at by for with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very can will just don should now
could ought would cannot
""".split()

# --- prompts --------------------------------------------------------------------------------------
CONTEXT_TEMPLATE = """### Context
Headline: {headline}
Keywords: {keywords}
Topic: {topic_label}
Sentiment: {sentiment}
COVID Status: {covid_status}

### Task
Write a concise, factual social-media post (≤ 280 characters) that accurately summarises the news article \
above. Focus on the key facts, preserve named entities, and maintain a {sentiment} tone.

### Summary"""

STRATEGY_TEMPLATES = {
    "structured": """### Context
{headline}

### Task
Summarise the above news article into a concise social-media post (≤ 280 characters).

### Focus
Retain key facts and named entities. Tone: {sentiment}.

### Summary""",
    "detailed": """You are a news summariser.

Article headline: {headline}

Article body: {description}

Instructions:
1. Write a single-sentence social-media post (≤ 280 characters).
2. Preserve all named entities (people, places, organisations).
3. Include at least one key fact or statistic from the article.
4. Use a {sentiment} tone.
5. Do NOT include hashtags or emojis.

Social-media post:""",
    "role_based": """You are a senior news editor at a leading wire service.

Story type: COVID-19 news ({covid_status})
Topic category: {topic_label}
Tone: {sentiment}

Headline: {headline}

Body: {description}

Produce a factual, jargon-free social-media post (≤ 280 characters) suitable for a general audience. \
Mention geography and key entities. Do not start with 'Here is'.

Post:""",
    "metadata_aware": """[METADATA]
Topic: {topic_label} | Keywords: {keywords} | Sentiment: {sentiment} | COVID: {covid_status}

[ARTICLE]
{headline}
{description}

[INSTRUCTION]
Write a concise, factual social-media post (≤ 280 characters) that captures the essential information above.

[POST]""",
}
DEFAULT_STRATEGY = "metadata_aware"
META_LINE = r"^(Topic|Topic category|Story type|Tone|Keywords|Sentiment|COVID Status): "
ARTICLE_LABEL = r"^(Headline|Article headline|Article body|Body): "
SENTENCE = r"[^.!?]+[.!?]*"
PROMPT_DEFAULTS = {"sentiment": "neutral", "covid_status": "unknown"}
PROMPT_COLUMNS = ["headline", "keywords", "topic_label", "sentiment", "covid_status", "cluster_id"]

# --- generated text -------------------------------------------------------------------------------
BATCH_SIZE = 8
MAX_POST_CHARS = 280
CHATTER_LINE = r"(Here is|Sure[,!]|Certainly[,!]|Of course[,!])[^\n]*\n*"  # after leading white space
POST_LABEL = r"(Post|Summary|Social-media post|Generated post)"  # then optional space, a colon, optional space

# --- evaluation -----------------------------------------------------------------------------------
ROUGE_TOKEN = r"[a-z0-9]+"
METRICS = ["sbert_similarity", "rouge1", "rouge2", "rougeL", "bertscore_p", "bertscore_r", "bertscore_f1"]
SUMMARY_STATS = ["mean", "std", "min", "median", "max"]
TOP_K = 5
HEADLINE_CHARS = 80
GENERATED_CHARS = 120
