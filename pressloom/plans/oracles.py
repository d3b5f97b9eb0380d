"""DuckDB SQL that computes what each registered query computes, from the given tables alone."""

from pressloom.functions import fixed_values as V
from pressloom.functions import stemming
from pressloom.operators.generate import prompt_words


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rnd(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def replace_all(expression: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({expression}, {q(pattern)}, {q(by)}, 'g')"


def collapse(expression: str) -> str:
    return f"trim({replace_all(expression, V.WHITESPACE + '+')}, ' ')"


def strip_html(expression: str) -> str:
    return collapse(replace_all(expression, V.HTML_TAG))


def entities(expression: str) -> str:
    return replace_all(expression, "(?i)" + V.HTML_ENTITY)


def to_ascii(expression: str) -> str:
    return replace_all(f"nfc_normalize({expression})", V.NON_ASCII, "")


def special_chars(expression: str) -> str:
    return replace_all(expression, V.SPECIAL_CHAR)


def preprocess(expression: str) -> str:
    return collapse(special_chars(to_ascii(entities(expression))))


def near_key(expression: str) -> str:
    return collapse(f"lower({expression})")


def word_tokens(expression: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expression}, '')), {q(V.WORD_TOKEN)})"


def rouge_tokens(expression: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expression}, '')), {q(V.ROUGE_TOKEN)})"


def no_stop_words(expression: str) -> str:
    return f"list_filter({expression}, lambda x: x NOT IN {in_list(V.ENGLISH_STOP_WORDS)})"


def bigrams(tokens: str) -> str:
    return f"list_transform(range(1, greatest(len({tokens}), 1)), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"


def clean_generated(expression: str) -> str:
    ws = V.WHITESPACE + "*"
    once = f"regexp_replace({expression}, {q(f'(?i)^{ws}{V.CHATTER_LINE}')}, '')"
    once = f"regexp_replace({once}, {q(f'(?i)^{ws}{V.POST_LABEL}{ws}:{ws}')}, '')"
    return f"substr({collapse(once)}, 1, {V.MAX_POST_CHARS})"


def render(template: str, **renamed: str) -> str:
    """A prompt template as a SQL concatenation."""
    sql = q(template)
    for name in ("headline", "description", "keywords", "topic_label", "sentiment", "covid_status"):
        value = f"coalesce({renamed.get(name, name)}, {q(V.PROMPT_DEFAULTS.get(name, ''))})"
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


def stem(word: str) -> list[str]:
    """The stemming steps as a chain of CASE expressions, one per step, over the column ``word``."""
    forms = " ".join(f"WHEN {word} = {q(a)} THEN {q(b + '=')}" for a, b in stemming.IRREGULAR.items())
    chain = [f"CASE {forms} WHEN length({word}) < 4 THEN {word} || '=' ELSE {word} END"]
    for step in stemming.STEPS:
        cases = []
        for suffix, substitutions in step:
            value = word
            for pattern, tail in substitutions:
                value = f"regexp_replace({value}, {q(pattern)}, {q(chr(92) + '1' + tail)})"
            cases.append(f"WHEN ends_with({word}, {q(suffix)}) THEN {value}")
        chain.append(f"CASE {' '.join(cases)} ELSE {word} END")
    chain.append(f"rtrim({word}, '=')")
    return chain


# --- shared views ---------------------------------------------------------------------------------
ARTICLES = """articles AS (
  SELECT d.doc_id,
    CASE WHEN d.doc_id % 97 = 0 THEN NULL ELSE DATE '2020-01-01' + CAST(d.doc_id % 500 AS INTEGER) END AS date,
    split_part(d.text, chr(10), 1) AS headline,
    CASE WHEN instr(d.text, chr(10)) = 0 THEN NULL ELSE substr(d.text, instr(d.text, chr(10)) + 1) END AS description,
    CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.lang = 'en' THEN 'covid' ELSE 'non-covid' END AS covid_status,
    'https://img.example/' || d.doc_id AS image_url,
    d.source,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
         ELSE 'neutral' END AS sentiment
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

RAW = """raw AS (
  SELECT doc_id,
    CASE WHEN date IS NULL THEN 'not a date'
         WHEN doc_id % 5 = 0 THEN strftime(date, '%Y-%m-%d')
         WHEN doc_id % 5 = 1 THEN strftime(date, '%d/%m/%Y')
         WHEN doc_id % 5 = 2 THEN strftime(date, '%Y-%m-%d') || ' 00:00:00'
         WHEN doc_id % 5 = 3 THEN strftime(date, '%Y-%m-%d') || 'T00:00:00'
         ELSE 'N/A' END AS raw_date,
    CASE WHEN date IS NOT NULL AND doc_id % 5 <> 4 THEN date END AS date,
    CASE WHEN doc_id % 89 = 0 THEN '  ' ELSE ' <b>' || headline || '</b>' || chr(9) || chr(160) END AS headline,
    '<p class="x">' || description || '</p> &amp; "end"' AS description,
    coalesce(covid_status, 'NA') AS covid_status, image_url, source, coalesce(sentiment, '') AS sentiment
  FROM articles)"""

PAIRS = """pairs AS (
  SELECT g.conv_id * 100 + g.turn AS id, g.text AS generated_text, r.text AS target,
    CASE g.conv_id % 5 WHEN 0 THEN 'structured' WHEN 1 THEN 'detailed' WHEN 2 THEN 'role_based'
                       WHEN 3 THEN 'metadata_aware' END AS prompt_strategy,
    CASE WHEN g.conv_id % 2 = 0 THEN 'val' ELSE 'test' END AS split
  FROM conversations g JOIN conversations r ON r.conv_id = g.conv_id AND r.turn = g.turn - 1
  WHERE g.role = 'assistant')"""

VECTOR_PAIRS = """vector_pairs AS (
  SELECT a.vec_id AS id, CAST(a.embedding AS DOUBLE[]) AS g, CAST(b.embedding AS DOUBLE[]) AS r
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""

CENTRES = """centres AS (
  SELECT label AS cluster_id, list(m ORDER BY pos) AS center
  FROM (SELECT label, pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 9) AS m
        FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos)
  GROUP BY label)"""

NEAREST = """nearest AS (
  SELECT vec_id, cluster_id, d2 AS distance2 FROM (
    SELECT vec_id, cluster_id, d2, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster_id) AS nr
    FROM (SELECT e.vec_id, c.cluster_id,
            list_sum(list_transform(list_zip(e.embedding, c.center),
                     lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))) AS d2
          FROM embeddings e CROSS JOIN centres c))
  WHERE nr = 1)"""


def split_of(source: str, date: str, key: str) -> str:
    """Rows of ``source`` with their chronological split, by one global ranking."""
    return f"""(SELECT * EXCLUDE (nr, n), CASE WHEN nr <= floor(n * CAST(0.70 AS DOUBLE)) THEN 'train'
      WHEN nr <= floor(n * CAST(0.70 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {date} ASC NULLS LAST, {key}) AS nr, count(*) OVER () AS n FROM {source}))"""


SPLIT_ARTICLES = "split_articles AS " + split_of("articles", "date", "doc_id")


def term_counts(name: str, source: str, key: str, text: str) -> str:
    """CTEs ending in ``name``: (key, term, tf) over unigrams and bigrams."""
    return f"""{name}_t AS (SELECT {key}, {no_stop_words(word_tokens(text))} AS t FROM {source}),
{name} AS (SELECT {key}, term, count(*) AS tf
  FROM (SELECT {key}, unnest(list_concat(t, {bigrams('t')})) AS term FROM {name}_t) GROUP BY {key}, term)"""


def vocabulary(counts: str, n_docs: str) -> str:
    return f"""vocabulary AS (
  SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, df, corpus_count,
         ln((1 + n_docs) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_count, ({n_docs}) AS n_docs
        FROM {counts} GROUP BY term
        HAVING count(*) >= {V.MIN_DF} AND count(*) <= CAST({V.MAX_DF} AS DOUBLE) * ({n_docs})
        ORDER BY corpus_count DESC, term LIMIT {V.MAX_FEATURES}))"""


def weights(name: str, counts: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key}, term_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight
  FROM (SELECT c.{key}, v.term_id, v.term, c.tf, (1 + ln(c.tf)) * v.idf AS w
        FROM {counts} c JOIN vocabulary v ON v.term = c.term))"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def recursive(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


ALL_COUNTS = term_counts("counts", "articles", "doc_id", "headline")
ALL_VOCABULARY = vocabulary("counts", "SELECT count(*) FROM articles")
TRAIN_COUNTS = term_counts("counts", "split_articles", "doc_id", "headline")
TRAIN_VOCABULARY = (
    "train_counts AS (SELECT * FROM counts WHERE doc_id IN (SELECT doc_id FROM split_articles WHERE split = 'train')),\n"
    + vocabulary("train_counts", "SELECT count(*) FROM split_articles WHERE split = 'train'")
)
KEYWORDS = """keywords AS (
  SELECT a.doc_id, coalesce(string_agg(k.term, ', ' ORDER BY k.nr), '') AS keywords
  FROM split_articles a LEFT JOIN (
    SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS nr FROM weights
  ) k ON k.doc_id = a.doc_id AND k.nr <= 5 GROUP BY a.doc_id)"""
TFIDF_ON_TRAIN = (ARTICLES, SPLIT_ARTICLES, TRAIN_COUNTS, TRAIN_VOCABULARY, weights("weights", "counts", "doc_id"))

PROMPT_ARTICLES = f"""prompt_articles AS (
  SELECT doc_id AS id, headline, coalesce(description, '') AS target,
    array_to_string(list_sort(list_distinct({word_tokens('headline')})), ', ') AS keywords, source AS topic_label, sentiment, covid_status
  FROM articles)"""


# --- ROUGE ----------------------------------------------------------------------------------------
def overlap_f1(name: str, source: str, grams: str) -> str:
    """(id, f1) of clipped overlap; ``source`` has id, g and r token lists, ``grams`` maps a list."""
    return f"""{name}_l AS (SELECT id, {grams.format('g')} AS g, {grams.format('r')} AS r FROM {source}),
{name}_g AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(g) AS t FROM {name}_l) GROUP BY id, t),
{name}_r AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(r) AS t FROM {name}_l) GROUP BY id, t),
{name}_o AS (SELECT a.id, sum(least(a.n, b.n)) AS o FROM {name}_g a JOIN {name}_r b ON a.id = b.id AND a.t = b.t GROUP BY a.id),
{name} AS (SELECT l.id, CASE WHEN len(g) + len(r) = 0 THEN 0.0
    ELSE 2.0 * CAST(coalesce(o, 0) AS DOUBLE) / (len(g) + len(r)) END AS f1
  FROM {name}_l l LEFT JOIN {name}_o o ON o.id = l.id)"""


def lcs_f1(name: str, source: str) -> str:
    """(id, f1) of the longest common subsequence: one table row per step of a recursive query."""
    return f"""{name}_s AS (
  SELECT id, 0 AS i, g, r, list_transform(r, lambda x: 0) AS row FROM {source}
  UNION ALL
  SELECT id, i + 1, g, r,
    list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
      greatest(row[k], CASE WHEN r[k] = g[i + 1] THEN 1 + CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END ELSE 0 END))))
  FROM {name}_s WHERE i < len(g)),
{name} AS (SELECT id, CASE WHEN len(g) + len(r) = 0 THEN 0.0
    ELSE 2.0 * coalesce(row[len(r)], 0) / (len(g) + len(r)) END AS f1 FROM {name}_s WHERE i = len(g))"""


UNIGRAMS, BIGRAMS = "{0}", bigrams("{0}")
PAIR_TOKENS = f"""pair_tokens AS (
  SELECT id, {rouge_tokens('generated_text')} AS g, {rouge_tokens('target')} AS r FROM pairs)"""


def _stem_ctes(source: str) -> tuple[str, ...]:
    """(token, stem) for the tokens in ``source``, a query with a column ``token``."""
    ctes, previous = [f"stem_0 AS (SELECT DISTINCT token, token AS w FROM ({source}))"], "stem_0"
    for i, expression in enumerate(stem("w"), start=1):
        ctes.append(f"stem_{i} AS (SELECT token, {expression} AS w FROM {previous})")
        previous = f"stem_{i}"
    ctes.append(f"stems AS (SELECT token, w AS stem FROM {previous})")
    return tuple(ctes)


STEMMED_PAIRS = (
    *_stem_ctes("SELECT unnest(g) AS token FROM pair_tokens UNION ALL SELECT unnest(r) AS token FROM pair_tokens"),
    """stem_map AS (SELECT map(list(token), list(stem)) AS m FROM stems)""",
    """stemmed AS (SELECT id, list_transform(g, lambda x: m[x]) AS g, list_transform(r, lambda x: m[x]) AS r
  FROM pair_tokens, stem_map)""",
)
SCORED = (
    PAIRS,
    PAIR_TOKENS,
    overlap_f1("r1", "pair_tokens", UNIGRAMS),
    overlap_f1("r2", "pair_tokens", BIGRAMS),
    """scored AS (SELECT p.*, r1.f1 AS rouge1, r2.f1 AS rouge2
  FROM pairs p JOIN r1 ON r1.id = p.id JOIN r2 ON r2.id = p.id)""",
)



def stat_columns(metric: str, name: str, wrap=rnd) -> str:
    stats = {"mean": f"avg({metric})", "std": f"stddev_samp({metric})", "min": f"min({metric})",
             "median": f"median({metric})", "max": f"max({metric})"}
    return ", ".join(f"{wrap(e)} AS {name}{s}" for s, e in stats.items())


def wide_summary(source: str, metrics) -> str:
    columns = ", ".join(stat_columns(m, m + "_") for m in metrics)
    return f"""SELECT split, prompt_strategy, {columns} FROM {source}
WHERE prompt_strategy IS NOT NULL GROUP BY split, prompt_strategy"""


MEANS = """means AS (
  SELECT split, prompt_strategy, 'rouge1' AS metric, avg(rouge1) AS mean FROM scored GROUP BY split, prompt_strategy
  UNION ALL SELECT split, prompt_strategy, 'rouge2', avg(rouge2) FROM scored GROUP BY split, prompt_strategy)"""


def _report() -> str:
    columns = [f"{m}_{s}" for m in ("rouge1", "rouge2") for s in V.SUMMARY_STATS]
    cells = " || ' | ' || ".join(f"coalesce(printf('%.4f', {c}), 'nan')" for c in columns)
    sections = []
    for i, name in enumerate(("val", "test", "train"), start=1):
        head = "| split | prompt_strategy | " + " | ".join(columns) + " |"
        rule = "|" + "---|" * (len(columns) + 2)
        some = f"EXISTS (SELECT 1 FROM summary WHERE split = '{name}')"
        sections += [
            f"SELECT {i}, 0, 0, '## {name.capitalize()} Set Results'", f"SELECT {i}, 0, 1, ''",
            f"SELECT {i}, 1, 0, CASE WHEN {some} THEN {q(head)} ELSE '_No results available._' END",
            f"SELECT {i}, 1, 1, {q(rule)} WHERE {some}",
            f"""SELECT {i}, 2, row_number() OVER (ORDER BY prompt_strategy), '| ' || split || ' | ' || prompt_strategy || ' | ' || {cells} || ' |'
 FROM summary WHERE split = '{name}'""",
            f"SELECT {i}, 3, 0, ''", f"SELECT {i}, 3, 1, '---'", f"SELECT {i}, 3, 2, ''",
        ]
    lines = " UNION ALL ".join(
        ["SELECT 0 AS s, 0 AS p, 0 AS n, '# Evaluation Report' AS line", "SELECT 0, 0, 1, ''", "SELECT 0, 0, 2, '---'",
         "SELECT 0, 0, 3, ''", *sections]
    )
    raw = ", ".join(stat_columns(m, m + "_", wrap=str) for m in ("rouge1", "rouge2"))
    return with_(
        *SCORED,
        f"""summary AS (SELECT split, prompt_strategy, {raw} FROM scored WHERE prompt_strategy IS NOT NULL
  GROUP BY split, prompt_strategy)""",
        f"lines AS ({lines})",
        select="SELECT CAST(row_number() OVER (ORDER BY s, p, n) AS INTEGER) AS line_no, line FROM lines",
    )


def null_if_na(column: str) -> str:
    return f"CASE WHEN {column} IN {in_list(V.NA_TOKENS)} THEN NULL ELSE {column} END"


ARTICLE_TYPES = {"doc_id": "bigint", "date": "date", "headline": "string", "description": "string",
                 "covid_status": "string", "image_url": "string", "source": "string", "sentiment": "string"}

# P1: what the ingest job leaves, from the raw layout.
CLEANED = f"""cleaned AS (
  SELECT doc_id, date, {strip_html(null_if_na('headline'))} AS headline, {strip_html('description')} AS description,
    coalesce({null_if_na('covid_status')}, 'unknown') AS covid_status, image_url, source,
    coalesce({null_if_na('sentiment')}, 'neutral') AS sentiment FROM raw),
ingested AS (
  SELECT * EXCLUDE (nr) FROM (
    SELECT *, row_number() OVER (PARTITION BY headline ORDER BY doc_id) AS nr FROM cleaned
    WHERE headline IS NOT NULL AND headline <> '' AND description IS NOT NULL AND description <> '')
  WHERE nr = 1)"""
PREPARED = f"""normal AS (
  SELECT * REPLACE ({preprocess('headline')} AS headline, {preprocess('description')} AS description) FROM ingested),
unique_rows AS (
  SELECT * EXCLUDE (nr) FROM (
    SELECT *, row_number() OVER (PARTITION BY {near_key('headline')} ORDER BY doc_id) AS nr FROM normal) WHERE nr = 1),
split_articles AS {split_of('unique_rows', 'date', 'doc_id')}"""

# Singular vectors have as many components as the vocabulary has terms, 100 at most.
DIMENSIONS = "(SELECT least(100, count(*)) FROM vocabulary) AS dimensions"



def central_sentence(source: str) -> tuple[str, ...]:
    """CTEs ending in ``answers`` (id, prompt_strategy, raw) for the prompts in ``source``."""
    def words(text: str) -> str:
        return f"list_filter({word_tokens(text)}, lambda w: w NOT IN {in_list(prompt_words())})"

    return (
        f"""prompt_counts AS (SELECT id, prompt_strategy, w, count(*) AS n FROM (
  SELECT id, prompt_strategy, unnest({words('prompt_text')}) AS w FROM {source}) GROUP BY id, prompt_strategy, w)""",
        f"""prompt_lines AS (SELECT id, prompt_strategy, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line
  FROM (SELECT id, prompt_strategy, string_split(prompt_text, chr(10)) AS ls FROM {source}))""",
        f"""sentences AS (SELECT id, prompt_strategy, ln, generate_subscripts(ss, 1) AS sn, unnest(ss) AS sentence
  FROM (SELECT id, prompt_strategy, ln, regexp_extract_all(regexp_replace(line, {q(V.ARTICLE_LABEL)}, ''), {q(V.SENTENCE)}) AS ss
        FROM prompt_lines WHERE NOT regexp_matches(line, {q(V.META_LINE)})))""",
        f"""sentence_words AS (SELECT DISTINCT id, prompt_strategy, ln, sn, w FROM (
  SELECT id, prompt_strategy, ln, sn, unnest({words('sentence')}) AS w FROM sentences))""",
        """best_sentence AS (SELECT id, prompt_strategy, first(ln ORDER BY score DESC, ln, sn) AS ln, first(sn ORDER BY score DESC, ln, sn) AS sn
  FROM (SELECT id, prompt_strategy, ln, sn, sum(n) AS score
        FROM sentence_words JOIN prompt_counts USING (id, prompt_strategy, w) GROUP BY id, prompt_strategy, ln, sn)
  GROUP BY id, prompt_strategy)""",
        f"""answers AS (SELECT p.id, p.prompt_strategy, p.prompt_text, coalesce({collapse('s.sentence')}, '') AS raw
  FROM {source} p LEFT JOIN best_sentence b USING (id, prompt_strategy) LEFT JOIN sentences s USING (id, prompt_strategy, ln, sn))""",
    )


STRATEGIES = "(SELECT unnest(['structured', 'detailed', 'role_based', 'metadata_aware']) AS prompt_strategy)"


def strategy_sql(name: str) -> str:
    return with_(ARTICLES, PROMPT_ARTICLES,
                 select=f"SELECT id, {render(V.STRATEGY_TEMPLATES[name], description='target')} AS prompt_text FROM prompt_articles")


def prompt_by(column: str) -> str:
    cases = " ".join(
        f"WHEN {q(n)} THEN {render(t, description='target')}" for n, t in V.STRATEGY_TEMPLATES.items()
    )
    return f"CASE {column} {cases} ELSE {render(V.STRATEGY_TEMPLATES[V.DEFAULT_STRATEGY], description='target')} END"


SOFT_MATCH = (
    PAIRS,
    PAIR_TOKENS,
    """occurrences AS (
  SELECT id, 'g' AS side, unnest(g) AS token FROM pair_tokens
  UNION ALL SELECT id, 'r', unnest(r) FROM pair_tokens)""",
    """known_tokens AS (SELECT token FROM occurrences)""",
    """side_counts AS (SELECT id, side, token, count(*) AS tf FROM occurrences GROUP BY id, side, token)""",
    """token_vectors AS (
  SELECT t.token, list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x) AS v
  FROM (SELECT DISTINCT token FROM known_tokens) t
  JOIN embeddings e ON e.vec_id = CAST('0x' || substr(md5(t.token), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings))""",
    """sims AS (
  SELECT a.id, a.token AS g_token, a.tf AS g_tf, b.token AS r_token, b.tf AS r_tf,
    list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) AS s
  FROM side_counts a JOIN side_counts b ON a.id = b.id AND a.side = 'g' AND b.side = 'r'
  JOIN token_vectors x ON x.token = a.token JOIN token_vectors y ON y.token = b.token)""",
    """best_g AS (SELECT id, sum(m * tf) / sum(tf) AS p FROM (
    SELECT id, g_token, max(s) AS m, any_value(g_tf) AS tf FROM sims GROUP BY id, g_token) GROUP BY id)""",
    """best_r AS (SELECT id, sum(m * tf) / sum(tf) AS r FROM (
    SELECT id, r_token, max(s) AS m, any_value(r_tf) AS tf FROM sims GROUP BY id, r_token) GROUP BY id)""",
    """matched AS (SELECT pairs.id, coalesce(p, 0.0) AS p, coalesce(r, 0.0) AS r
  FROM pairs LEFT JOIN best_g ON best_g.id = pairs.id LEFT JOIN best_r ON best_r.id = pairs.id)""",
)



def similarity(targets: str) -> tuple[str, ...]:
    """CTEs ending in ``text_likeness`` (id, s): cosine of TF-IDF rows of ``pairs``, vocabulary of the texts in ``targets``."""
    return (
        term_counts("fit_counts", targets, "id", "target"),
        vocabulary("fit_counts", f"SELECT count(*) FROM {targets}"),
        term_counts("ref_counts", "pairs", "id", "target"),
        weights("ref_weights", "ref_counts", "id"),
        term_counts("gen_counts", "pairs", "id", "generated_text"),
        weights("gen_weights", "gen_counts", "id"),
        """text_likeness AS (SELECT a.id, sum(a.weight * b.weight) AS s
  FROM gen_weights a JOIN ref_weights b ON a.id = b.id AND a.term_id = b.term_id GROUP BY a.id)""",
    )


def all_metrics(targets: str = "pairs", known: str | None = None) -> tuple[str, ...]:
    """CTEs from ``pairs`` to ``all_scores``: the pairs with all seven metrics. ``known``: a query of tokens with a vector."""
    soft = list(SOFT_MATCH[2:])
    if known:
        soft[1] = f"known_tokens AS ({known})"
    return (
        PAIR_TOKENS, *STEMMED_PAIRS, overlap_f1("r1", "stemmed", UNIGRAMS), overlap_f1("r2", "stemmed", BIGRAMS),
        lcs_f1("rl", "stemmed"), *similarity(targets), *soft,
        """all_scores AS (SELECT pairs.*, coalesce(text_likeness.s, 0.0) AS sbert_similarity, r1.f1 AS rouge1, r2.f1 AS rouge2,
    rl.f1 AS "rougeL", matched.p AS bertscore_p, matched.r AS bertscore_r,
    CASE WHEN matched.p + matched.r = 0 THEN 0.0 ELSE 2 * matched.p * matched.r / (matched.p + matched.r) END AS bertscore_f1
  FROM pairs LEFT JOIN text_likeness ON text_likeness.id = pairs.id JOIN r1 ON r1.id = pairs.id JOIN r2 ON r2.id = pairs.id
  JOIN rl ON rl.id = pairs.id JOIN matched ON matched.id = pairs.id)""",
    )


METRIC_COLUMNS = ", ".join(f'{rnd(chr(34) + m + chr(34))} AS "{m}"' for m in V.METRICS)

COMPONENTS = """components AS (
  SELECT v.term_id, v.term, CAST(e.embedding AS DOUBLE[]) AS vector
  FROM vocabulary v JOIN embeddings e ON e.vec_id = v.term_id % (SELECT count(*) FROM embeddings))"""
LABELS = """labels_of AS (
  SELECT cluster_id, string_agg(term, ' | ' ORDER BY nr) AS topic_label FROM (
    SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, term) AS nr
    FROM (SELECT c.cluster_id, t.term, round(list_dot_product(c.center, t.vector), 9) AS w FROM centres c CROSS JOIN components t))
  WHERE nr <= 5 GROUP BY cluster_id)"""

PROJECTED = """projected AS (
  SELECT a.doc_id, p.pos, coalesce(sum(w.weight * c.vector[p.pos + 1]), 0.0) AS x
  FROM articles a CROSS JOIN (SELECT CAST(unnest(range(len(vector))) AS INTEGER) AS pos FROM components WHERE term_id = 0) p
  LEFT JOIN weights w ON w.doc_id = a.doc_id LEFT JOIN components c ON c.term_id = w.term_id
  GROUP BY a.doc_id, p.pos)"""
ON_ALL = (ARTICLES, ALL_COUNTS, ALL_VOCABULARY, weights("weights", "counts", "doc_id"), COMPONENTS, PROJECTED)

ORACLES = {
    "A1_read_articles": with_(ARTICLES, RAW, select=f"""SELECT doc_id, {null_if_na('raw_date')} AS "Date",
  {null_if_na('headline')} AS "Headline", {null_if_na('description')} AS "Description",
  {null_if_na('covid_status')} AS "Covid Status", image_url AS "Image URL", source AS "Source",
  {null_if_na('sentiment')} AS "Sentiment" FROM raw"""),
    "A1_different_headers": with_(ARTICLES, RAW, select=f"""SELECT doc_id, {null_if_na('raw_date')} AS "Date",
  {null_if_na('headline')} AS "Headline", {null_if_na('description')} AS "Description",
  {null_if_na('covid_status')} AS "Covid Status", image_url AS "Image URL", source AS "Source",
  CASE WHEN doc_id % 3 < 2 THEN {null_if_na('sentiment')} END AS "Sentiment" FROM raw"""),
    "A2_write_table": with_(ARTICLES, SPLIT_ARTICLES, select="SELECT doc_id, headline, source, split FROM split_articles"),
    "A2_write_csv": """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',')
  AS embedding, label FROM embeddings""",
    "A3_save_model": with_(ARTICLES, ALL_COUNTS, ALL_VOCABULARY,
                           select=f"SELECT term_id, term, df, corpus_count, {rnd('idf')} AS idf FROM vocabulary"),
    "A3_model_tables": with_(ARTICLES, ALL_COUNTS, ALL_VOCABULARY, CENTRES, COMPONENTS, LABELS,
        """long_components AS (SELECT term_id, term, CAST(pos - 1 AS INTEGER) AS pos, vector[pos] AS x
  FROM components, unnest(range(1, len(vector) + 1)) AS u(pos))""",
        select=f"""SELECT 'vocabulary' AS part, CAST(term_id AS BIGINT) AS id, CAST(NULL AS INTEGER) AS pos, term AS name, {rnd('idf')} AS value FROM vocabulary
UNION ALL SELECT 'components', term_id, pos, term, {rnd('x')} FROM long_components
UNION ALL SELECT 'singular_values', pos, NULL, NULL, {rnd('sqrt(sum(x * x))')} FROM long_components GROUP BY pos
UNION ALL SELECT 'centers', cluster_id, CAST(pos - 1 AS INTEGER), NULL, {rnd('center[pos]')} FROM centres, unnest(range(1, len(center) + 1)) AS u(pos)
UNION ALL SELECT 'labels', cluster_id, NULL, topic_label, NULL FROM labels_of"""),
    "A4_write_label_dictionary": """SELECT CAST(label AS VARCHAR) AS cluster_id, 'label | ' || count(*) AS topic_label
FROM embeddings GROUP BY label""",
    "A5_read_if_exists": with_(PAIRS, select="SELECT split, count(*) AS n FROM pairs GROUP BY split"),
    "A6_markdown_report": _report(),
    "B1_normalize_column_names": with_(ARTICLES, RAW, select="""SELECT doc_id, raw_date AS date, headline, description,
  covid_status, image_url, source, sentiment FROM raw"""),
    "B2_parse_dates": with_(ARTICLES, RAW, select="SELECT doc_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM raw"),
    "B2_count_bad_dates": with_(ARTICLES, RAW, select="""SELECT count(*) FILTER (WHERE raw_date IN ('not a date', 'N/A')) AS bad_dates,
  count(*) FILTER (WHERE raw_date IS NULL) AS missing_dates FROM raw"""),
    # the days behind the texts; day first is the only convention in which all of them can be read
    "B2_infer_dates": with_(ARTICLES, select="""SELECT doc_id, CASE WHEN doc_id % 8 <> 7 THEN strftime(date, '%Y-%m-%d') ||
  CASE WHEN doc_id % 8 = 5 THEN ' 08:30:00' ELSE ' 00:00:00' END END AS date FROM articles"""),
    "B2_date_convention": with_(ARTICLES, select="""SELECT count(*) FILTER (WHERE day(date) > 12) AS day_first_dates,
  0::BIGINT AS month_first_dates, count(*) AS numeric_dates, count(*) FILTER (WHERE day(date) > 12) > 0 AS day_first
FROM articles WHERE date IS NOT NULL AND doc_id % 8 IN (0, 1, 2, 4)"""),
    "B3_strip_html": f"SELECT page_id, {strip_html('html')} AS text FROM pages",
    "B4_drop_missing_critical": with_(ARTICLES, RAW, select=f"""SELECT doc_id, headline, description FROM raw
WHERE {collapse('headline')} <> '' AND {collapse('description')} <> ''"""),
    "B5_fill_optional_missing": with_(ARTICLES, select="""SELECT doc_id, coalesce(covid_status, 'unknown') AS covid_status,
  coalesce(sentiment, 'neutral') AS sentiment, coalesce(source, '') AS source, coalesce(image_url, '') AS image_url FROM articles"""),
    "B6_dedup_exact": with_(ARTICLES, select="""SELECT doc_id, headline, source, covid_status FROM (
  SELECT *, row_number() OVER (PARTITION BY headline ORDER BY doc_id) AS nr FROM articles) WHERE nr = 1"""),
    "B7a_profile_shape": with_(ARTICLES, select="SELECT * FROM (VALUES " + ", ".join(
        f"({q(c)}, {q(t)})" for c, t in ARTICLE_TYPES.items()) + """) AS t(column_name, dtype),
  (SELECT count(*) AS n_rows, 8 AS n_columns FROM articles)"""),
    "B7b_profile_nulls": with_(ARTICLES, select=" UNION ALL ".join(
        f"SELECT {q(c)} AS column_name, count(*) - count({c}) AS null_count FROM articles" for c in ARTICLE_TYPES)),
    "B7c_profile_value_counts": with_(ARTICLES, select=" UNION ALL ".join(
        f"SELECT {q(c)} AS column_name, {c} AS value, count(*) AS n FROM articles WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("covid_status", "sentiment"))),
    "B7d_profile_date_range": with_(ARTICLES, select="""SELECT strftime(min(date), '%Y-%m-%d') AS min_date,
  strftime(max(date), '%Y-%m-%d') AS max_date FROM articles"""),
    "C1_remove_html_entities": f"SELECT page_id, {entities('html')} AS text FROM pages",
    "C2_normalize_unicode": f"SELECT doc_id, {to_ascii('text')} AS text FROM documents",
    "C3_remove_special_chars": f"SELECT doc_id, {special_chars('text')} AS text FROM documents",
    "C4_collapse_whitespace": f"SELECT doc_id, {collapse('text')} AS text FROM documents",
    "C5_preprocess_text": with_(ARTICLES, select=f"""SELECT doc_id, {preprocess('headline')} AS headline,
  {preprocess('description')} AS description FROM articles"""),
    "C5_preprocess_pages": f"SELECT page_id, {preprocess('html')} AS text FROM pages",
    "C6_dedup_normalized": with_(ARTICLES, f"""both_forms AS (
  SELECT doc_id, headline, source FROM articles
  UNION ALL SELECT -1 - doc_id, '  ' || translate(replace(headline, ' ', '  '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), source FROM articles)""",
        select=f"""SELECT doc_id, headline, source FROM (
  SELECT *, row_number() OVER (PARTITION BY {near_key('headline')} ORDER BY doc_id) AS nr FROM both_forms) WHERE nr = 1"""),
    "C7_time_based_split": with_(ARTICLES, SPLIT_ARTICLES, select="SELECT doc_id, split FROM split_articles"),
    "C7_time_based_split_events": f"SELECT event_id, split FROM {split_of('events', 'ts', 'event_id')}",
    "C7_time_based_split_text_ids": with_(
        ARTICLES, "keyed AS (SELECT 'article-' || md5(CAST(doc_id AS VARCHAR)) AS key, date FROM articles)",
        select=f"SELECT key, split FROM {split_of('keyed', 'date', 'key')}"),
    "C8_dedup_report": with_(ARTICLES, select=f"""SELECT 'exact' AS step, count(*) AS rows_before,
  count(DISTINCT headline) AS rows_after, count(*) - count(DISTINCT headline) AS dropped FROM articles
UNION ALL SELECT 'normalized', count(*), count(DISTINCT {near_key('headline')}),
  count(*) - count(DISTINCT {near_key('headline')}) FROM articles"""),
    "C9_split_sizes": with_(ARTICLES, SPLIT_ARTICLES, select="SELECT split, count(*) AS n FROM split_articles GROUP BY split"),
    "D1_tokenize": f"SELECT doc_id, array_to_string({word_tokens('text')}, ' ') AS tokens FROM documents",
    "D2_remove_stop_words": f"SELECT doc_id, array_to_string({no_stop_words(word_tokens('text'))}, ' ') AS tokens FROM documents",
    "D3_ngrams": with_(ARTICLES, f"t AS (SELECT doc_id, {no_stop_words(word_tokens('headline'))} AS t FROM articles)",
                       select=f"SELECT doc_id, array_to_string(list_concat(t, {bigrams('t')}), '|') AS terms FROM t"),
    "D4_document_frequency": with_(ARTICLES, ALL_COUNTS, select="""SELECT term, count(*) AS df,
  CAST(sum(tf) AS BIGINT) AS corpus_count FROM counts GROUP BY term"""),
    "D5_fit_vocabulary": with_(ARTICLES, ALL_COUNTS, ALL_VOCABULARY, select="SELECT term_id, term, df, corpus_count FROM vocabulary"),
    "D6_fit_idf": with_(ARTICLES, ALL_COUNTS, ALL_VOCABULARY, select=f"SELECT term, {rnd('idf')} AS idf FROM vocabulary"),
    "D7_tfidf_transform": with_(*TFIDF_ON_TRAIN, select=f"SELECT doc_id, term_id, term, CAST(tf AS INTEGER) AS tf, {rnd('weight')} AS weight FROM weights"),
    "D8_top_keywords": with_(*TFIDF_ON_TRAIN, KEYWORDS, select="SELECT doc_id, keywords FROM keywords"),
    "D9_svd_invariants": with_(*TFIDF_ON_TRAIN, select="""SELECT CAST(i AS INTEGER) AS component, CAST(0 AS DOUBLE) AS off_orthonormal,
  CAST(0 AS DOUBLE) AS off_energy FROM range((SELECT least(100, count(*)) FROM vocabulary)) AS t(i)"""),
    "D10_explained_variance_fixed": with_(
        *ON_ALL,
        """total AS (SELECT sum(ss / n - (s / n) * (s / n)) AS t FROM (
  SELECT term_id, sum(weight) AS s, sum(weight * weight) AS ss FROM weights GROUP BY term_id),
  (SELECT count(*) AS n FROM articles))""",
        select=f"""SELECT pos AS component, {rnd('var_pop(x)')} AS variance, {rnd('var_pop(x) / any_value(t)')} AS ratio
FROM projected, total GROUP BY pos"""),
    "D11_svd_transform_fixed": with_(*ON_ALL, select=f"SELECT doc_id, pos, {rnd('x')} AS x FROM projected"),
    "D12_vector_to_text": """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',')
  AS svd_vector FROM embeddings""",
    "D12_text_to_vector": f"""SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos,
  {rnd("CAST(CAST(printf('%.6f', CAST(embedding[pos] AS DOUBLE)) AS FLOAT) AS DOUBLE)")} AS x
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)""",
    "D13_enrich_split": with_(*TFIDF_ON_TRAIN, KEYWORDS, COMPONENTS, PROJECTED, select=f"""SELECT k.doc_id, a.split, k.keywords, p.pos, {rnd('p.x')} AS x
FROM keywords k JOIN split_articles a ON a.doc_id = k.doc_id JOIN projected p ON p.doc_id = k.doc_id"""),
    "D14_tfidf_search": with_(
        term_counts("counts", "documents", "doc_id", "text"),
        vocabulary("counts", "SELECT count(*) FROM documents"),
        weights("doc_weights", "counts", "doc_id"),
        term_counts("asked", "(SELECT item_id AS query_id, text FROM benchmark)", "query_id", "text"),
        weights("query_weights", "asked", "query_id"),
        f"""scores AS (SELECT query_id, doc_id, {rnd('sum(a.weight * b.weight)')} AS score
  FROM query_weights a JOIN doc_weights b ON a.term_id = b.term_id GROUP BY query_id, doc_id)""",
        select="""SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10"""),
    "E1_kmeans_invariants": f"""WITH long AS (
  SELECT CAST(pos - 1 AS INTEGER) AS pos, CAST(embedding[pos] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(pos))
SELECT pos, {rnd('sum(x)', 4)} AS total FROM long GROUP BY pos UNION ALL SELECT -1, {rnd('sum(x * x)', 4)} FROM long""",
    "E2_assign_clusters": with_(CENTRES, NEAREST, select=f"SELECT vec_id, cluster_id, {rnd('distance2')} AS distance2 FROM nearest"),
    "E3_cluster_inertia": with_(CENTRES, NEAREST, select=f"SELECT {rnd('sum(distance2)')} AS inertia FROM nearest"),
    "E4_topic_labels": with_(ARTICLES, ALL_COUNTS, ALL_VOCABULARY, CENTRES, COMPONENTS, LABELS,
                             select="SELECT cluster_id, topic_label FROM labels_of"),
    "E5_attach_topic_label": with_(ARTICLES, ALL_COUNTS, ALL_VOCABULARY, CENTRES, COMPONENTS, LABELS, NEAREST,
                                   select="""SELECT n.vec_id, n.cluster_id, l.topic_label
FROM nearest n LEFT JOIN labels_of l ON l.cluster_id = n.cluster_id"""),
    "E6_build_prompt_context": with_(ARTICLES, PROMPT_ARTICLES,
                                     select=f"SELECT id, {render(V.CONTEXT_TEMPLATE)} AS prompt FROM prompt_articles"),
    "E7_build_prompt_dataset": with_(ARTICLES, select=f"""SELECT doc_id AS id,
  {render(V.CONTEXT_TEMPLATE, keywords='lower(headline)', topic_label='source')} AS prompt,
  coalesce(description, '') AS target, headline, lower(headline) AS keywords, source AS topic_label, sentiment, covid_status,
  length(source) AS cluster_id FROM articles"""),
    "F1_prompt_structured": strategy_sql("structured"),
    "F2_prompt_detailed": strategy_sql("detailed"),
    "F3_prompt_role_based": strategy_sql("role_based"),
    "F4_prompt_metadata_aware": strategy_sql("metadata_aware"),
    "F5_build_prompt": with_(ARTICLES, PROMPT_ARTICLES, """named AS (SELECT *, CASE id % 5 WHEN 0 THEN 'structured'
  WHEN 1 THEN 'detailed' WHEN 2 THEN 'role_based' WHEN 3 THEN 'metadata_aware' ELSE 'other' END AS prompt_strategy FROM prompt_articles)""",
        select=f"SELECT id, prompt_strategy, {prompt_by('prompt_strategy')} AS prompt_text FROM named"),
    "F6_generate_batch": with_(
        ARTICLES, PROMPT_ARTICLES, f"prompted AS (SELECT id, prompt_strategy, {prompt_by('prompt_strategy')} AS prompt_text FROM prompt_articles, {STRATEGIES})",
        *central_sentence("prompted"), select="SELECT id, prompt_strategy, raw AS generated_text FROM answers"),
    "F6_generate_once": with_(
        ARTICLES, PROMPT_ARTICLES, f"prompted AS (SELECT id, prompt_strategy, {prompt_by('prompt_strategy')} AS prompt_text FROM prompt_articles, {STRATEGIES})",
        *central_sentence("prompted"), select="SELECT id, prompt_strategy, raw AS generated_text FROM answers"),
    "F7_clean_generated_text": f"""SELECT conv_id, turn, {clean_generated('opening || text')} AS text FROM (
  SELECT *, CASE conv_id % 5 WHEN 0 THEN 'Sure! Let me see.' || chr(10) WHEN 1 THEN 'Here is the post' || chr(10) || chr(10)
    WHEN 2 THEN '  Post : ' WHEN 3 THEN 'certainly, gladly' || chr(10) || 'Summary:' || chr(10) ELSE '' END AS opening
  FROM conversations)""",
    "F8_tag_generation": with_(PAIRS, select=f"""SELECT id, {clean_generated('generated_text')} AS generated_text,
  'detailed' AS prompt_strategy FROM pairs"""),
    "F9_run_strategies": with_(ARTICLES, PROMPT_ARTICLES, select=f"""SELECT id, prompt_strategy, {prompt_by('prompt_strategy')} AS prompt_text
FROM prompt_articles, (SELECT unnest(['structured', 'detailed', 'role_based', 'metadata_aware']) AS prompt_strategy)"""),
    "G1_cosine_similarity": with_(VECTOR_PAIRS, select=f"""SELECT id,
  {rnd('list_dot_product(g, r) / sqrt(list_dot_product(g, g) * list_dot_product(r, r))')} AS sbert_similarity FROM vector_pairs"""),
    "G2_embed_text": with_(
        PAIRS,
        term_counts("counts", "pairs", "id", "target"),
        vocabulary("counts", "SELECT count(*) FROM pairs"),
        weights("ref_weights", "counts", "id"),
        term_counts("gen_counts", "pairs", "id", "generated_text"),
        weights("gen_weights", "gen_counts", "id"),
        "dots AS (SELECT a.id, sum(a.weight * b.weight) AS s FROM gen_weights a JOIN ref_weights b ON a.id = b.id AND a.term_id = b.term_id GROUP BY a.id)",
        select=f"SELECT p.id, {rnd('coalesce(s, 0.0)')} AS sbert_similarity FROM pairs p LEFT JOIN dots d ON d.id = p.id"),
    "G2_weighted_token_vectors": recursive(
        *SOFT_MATCH[:6],
        """shares AS (SELECT token, 0.001 / (0.001 + sum(tf) / (SELECT sum(tf) FROM side_counts)) AS weight
  FROM side_counts GROUP BY token)""",
        """text_vectors AS (
  SELECT id, side, pos, sum(c.tf * s.weight * t.v[pos]) / sum(c.tf) AS x
  FROM side_counts c JOIN shares s ON s.token = c.token JOIN token_vectors t ON t.token = c.token,
    unnest(range(1, len(t.v) + 1)) AS u(pos) GROUP BY id, side, pos)""",
        """products AS (SELECT list(line ORDER BY i) AS m FROM (
  SELECT i, list(g ORDER BY j) AS line FROM (
    SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) AS g FROM text_vectors a
    JOIN text_vectors b ON a.id = b.id AND a.side = b.side GROUP BY i, j) GROUP BY i))""",
        # the greatest eigenvector by power iteration
        """direction AS (
  SELECT 0 AS step, list_transform(m, lambda line: CAST(1.0 AS DOUBLE)) AS v FROM products
  UNION ALL
  SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (
    SELECT step, list_transform(m, lambda line: list_dot_product(line, v)) AS w FROM direction, products WHERE step < 300))""",
        """along AS (SELECT t.id, t.side, sum(t.x * d.v[t.pos]) AS s FROM text_vectors t, direction d WHERE d.step = 300 GROUP BY t.id, t.side)""",
        """left_over AS (SELECT t.id, t.side, list(t.x - a.s * d.v[t.pos] ORDER BY t.pos) AS v
  FROM text_vectors t JOIN along a ON a.id = t.id AND a.side = t.side, direction d WHERE d.step = 300 GROUP BY t.id, t.side)""",
        select=f"""SELECT p.id, {rnd('coalesce(list_dot_product(g.v, r.v) / sqrt(list_dot_product(g.v, g.v) * list_dot_product(r.v, r.v)), 0.0)')}
  AS sbert_similarity
FROM pairs p LEFT JOIN left_over g ON g.id = p.id AND g.side = 'g' LEFT JOIN left_over r ON r.id = p.id AND r.side = 'r'"""),
    "G3_rouge1": with_(PAIRS, PAIR_TOKENS, overlap_f1("r1", "pair_tokens", UNIGRAMS), select=f"SELECT id, {rnd('f1')} AS rouge1 FROM r1"),
    "G4_rouge2": with_(PAIRS, PAIR_TOKENS, overlap_f1("r2", "pair_tokens", BIGRAMS), select=f"SELECT id, {rnd('f1')} AS rouge2 FROM r2"),
    "G5_rougeL": recursive(PAIRS, PAIR_TOKENS, lcs_f1("rl", "pair_tokens"), select=f'SELECT id, {rnd("f1")} AS "rougeL" FROM rl'),
    "G6_stem_tokens": with_(*_stem_ctes(f"SELECT unnest({rouge_tokens('text')}) AS token FROM documents"),
                            select="SELECT token, stem FROM stems"),
    "G6_rouge_stemmed": with_(PAIRS, PAIR_TOKENS, *STEMMED_PAIRS, overlap_f1("r1", "stemmed", UNIGRAMS),
                              overlap_f1("r2", "stemmed", BIGRAMS),
                              select=f"SELECT r1.id, {rnd('r1.f1')} AS rouge1, {rnd('r2.f1')} AS rouge2 FROM r1 JOIN r2 ON r1.id = r2.id"),
    "G7_soft_token_score": with_(*SOFT_MATCH, select=f"""SELECT id, {rnd('p')} AS bertscore_p, {rnd('r')} AS bertscore_r,
  {rnd('CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END')} AS bertscore_f1 FROM matched"""),
    "G7_token_ppmi": with_(
        f"words AS (SELECT conv_id, turn, generate_subscripts(ts, 1) AS i, unnest(ts) AS token FROM (SELECT conv_id, turn, {rouge_tokens('text')} AS ts FROM conversations))",
        "token_counts AS (SELECT token, count(*) AS n FROM words GROUP BY token)",
        "contexts AS (SELECT token FROM token_counts ORDER BY n DESC, token LIMIT 20000)",
        """kept AS (SELECT a.token, b.token AS context, count(*) AS n
  FROM words a JOIN words b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.i <> b.i AND abs(a.i - b.i) <= 5
  WHERE a.token IN (SELECT token FROM token_counts WHERE n >= 2) AND b.token IN (SELECT token FROM contexts) GROUP BY 1, 2)""",
        """ratios AS (SELECT token, context, n, CAST(n AS DOUBLE) * CAST(sum(n) OVER () AS BIGINT)
    / (CAST(sum(n) OVER (PARTITION BY token) AS DOUBLE) * CAST(sum(n) OVER (PARTITION BY context) AS BIGINT)) AS ratio FROM kept)""",
        select=f"SELECT token, context, n, {rnd('ln(ratio)')} AS ppmi FROM ratios WHERE ratio > 1"),
    "G8_evaluate_generations": recursive(PAIRS, *all_metrics(), select=f"SELECT id, {METRIC_COLUMNS} FROM all_scores"),
    "G9_contrast_ratio": with_(
        VECTOR_PAIRS,
        """unrelated AS (SELECT a.id, avg(list_dot_product(a.g, b.r) / sqrt(list_dot_product(a.g, a.g) * list_dot_product(b.r, b.r))) AS u
  FROM vector_pairs a JOIN vector_pairs b ON a.id <> b.id GROUP BY a.id)""",
        """means AS (SELECT avg(list_dot_product(g, r) / sqrt(list_dot_product(g, g) * list_dot_product(r, r))) AS m,
  avg(u) AS u FROM vector_pairs v JOIN unrelated n ON n.id = v.id)""",
        select=f"SELECT {rnd('m')} AS matched_mean, {rnd('u')} AS unrelated_mean, {rnd('m / u')} AS contrast_ratio FROM means"),
    "H1_ensure_metrics": recursive(PAIRS, *all_metrics(), select=f"SELECT id, {METRIC_COLUMNS} FROM (SELECT * REPLACE (CAST(0.5 AS DOUBLE) AS sbert_similarity) FROM all_scores)"),
    "H2_evaluate_split": recursive(PAIRS, *all_metrics(), select=f"SELECT id, split, prompt_strategy, {METRIC_COLUMNS} FROM all_scores"),
    "H3_summary_by_strategy": with_(*SCORED, select=wide_summary("scored", ("rouge1", "rouge2"))),
    "H4_summary_long": with_(*SCORED, select=f"""SELECT split, 'rouge1' AS metric, {stat_columns('rouge1', '')} FROM scored GROUP BY split
UNION ALL SELECT split, 'rouge2', {stat_columns('rouge2', '')} FROM scored GROUP BY split"""),
    "H5_top_k_samples": with_(*SCORED, select=f"""SELECT split, id, {rnd('rouge1')} AS score, substr(target, 1, 80) AS headline,
  substr(generated_text, 1, 120) AS generated, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY rouge1 DESC NULLS LAST, id) AS rank FROM scored) WHERE rank <= 5"""),
    "H6_bottom_k_samples": with_(*SCORED, select=f"""SELECT split, id, {rnd('coalesce(score, -1.0)')} AS score, substr(target, 1, 80) AS headline,
  substr(generated_text, 1, 120) AS generated, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY score ASC NULLS FIRST, id DESC) AS rank
  FROM (SELECT *, CASE WHEN id % 13 <> 0 THEN rouge1 END AS score FROM scored)) WHERE rank <= 5"""),
    "H7_combine_summaries": with_(*SCORED, select=wide_summary("scored", ("rouge1", "rouge2"))),
    "H8_compare_strategies": with_(*SCORED, MEANS, select="SELECT split, metric, " + ", ".join(
        f"{rnd(f'max(mean) FILTER (WHERE prompt_strategy = {q(n)})')} AS {n}" for n in V.STRATEGY_TEMPLATES)
        + """,
  first(prompt_strategy ORDER BY mean DESC, prompt_strategy) AS best_strategy
FROM means WHERE prompt_strategy IS NOT NULL GROUP BY split, metric"""),
    "H9_delta_vs_baseline": with_(*SCORED, MEANS,
        f"""sides AS (SELECT split, metric, max(mean) FILTER (WHERE prompt_strategy = 'structured') AS a,
  max(mean) FILTER (WHERE prompt_strategy = 'metadata_aware') AS b FROM means GROUP BY split, metric)""",
        select=f"SELECT split, metric, {rnd('a')} AS baseline_mean, {rnd('b')} AS strategy_mean, {rnd('b - a')} AS delta FROM sides"),
    "H10_run_evaluation": recursive(PAIRS, *all_metrics(), select=wide_summary("all_scores", V.METRICS)),
    "P1_ingest_and_clean": with_(ARTICLES, RAW, CLEANED, select="SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM ingested"),
    "P1_ingest_profile": with_(ARTICLES, RAW, CLEANED, select=" UNION ALL ".join([
        "SELECT 'step' AS part, 'loaded' AS name, count(*) AS n FROM raw",
        # what no format reads is the text 'not a date' of the raw view
        "SELECT 'step', 'bad_dates', count(*) FROM raw WHERE raw_date = 'not a date'",
        "SELECT 'step', 'with_text', count(*) FROM cleaned WHERE headline <> '' AND description <> ''",
        "SELECT 'step', 'unique', count(*) FROM ingested",
        *[f"SELECT 'nulls', {q(c)}, count(*) - count({c}) FROM ingested" for c in ARTICLE_TYPES],
        *[f"SELECT 'value', {q(c + '=')} || {c}, count(*) FROM ingested GROUP BY {c}" for c in ("covid_status", "sentiment")],
        *[f"SELECT 'rows', {q(c)}, count(*) FROM ingested" for c in ARTICLE_TYPES],
    ])),
    "P2_preprocess_and_split": with_(ARTICLES, RAW, CLEANED, PREPARED, select="""SELECT doc_id, headline, description,
  strftime(date, '%Y-%m-%d') AS date, split FROM split_articles"""),
    "P3_extract_keywords": with_(ARTICLES, RAW, CLEANED, PREPARED, TRAIN_COUNTS, TRAIN_VOCABULARY,
                                 weights("weights", "counts", "doc_id"), KEYWORDS,
                                 select=f"""SELECT k.doc_id, a.split, k.keywords, {DIMENSIONS}
FROM keywords k JOIN split_articles a ON a.doc_id = k.doc_id"""),
    "P3_job_vectors": with_(ARTICLES, RAW, CLEANED, PREPARED, TRAIN_COUNTS, TRAIN_VOCABULARY,
                            weights("weights", "counts", "doc_id"), KEYWORDS, COMPONENTS,
                            PROJECTED.replace("FROM articles a", "FROM split_articles a"),
                            select=f"""SELECT k.doc_id, a.split, k.keywords, p.pos, {rnd('p.x')} AS x
FROM keywords k JOIN split_articles a ON a.doc_id = k.doc_id JOIN projected p ON p.doc_id = k.doc_id"""),
    "P4_cluster_and_build_prompts": with_(ARTICLES, RAW, CLEANED, PREPARED, TRAIN_COUNTS, TRAIN_VOCABULARY,
                                          weights("weights", "counts", "doc_id"), KEYWORDS,
                                          select="""SELECT a.doc_id AS id, a.description AS target, a.headline, k.keywords,
  a.sentiment, a.covid_status, a.split, true AS has_cluster, true AS has_label, true AS prompt_fits
FROM keywords k JOIN split_articles a ON a.doc_id = k.doc_id"""),
    "P5_run_generation": recursive(
        f"""chats AS (WITH {PAIRS} SELECT id, generated_text AS headline, target, split AS topic_label, NULL AS sentiment, NULL AS covid_status,
    array_to_string(list_sort(list_distinct({word_tokens('target')})), ', ') AS keywords FROM pairs)""",
        f"prompted AS (SELECT id, prompt_strategy, {prompt_by('prompt_strategy')} AS prompt_text FROM chats, {STRATEGIES})",
        *central_sentence("prompted"),
        f"""pairs AS (SELECT id AS chat_id, row_number() OVER (ORDER BY id, prompt_strategy) AS id, prompt_strategy, prompt_text,
    {clean_generated('raw')} AS generated_text, target FROM answers JOIN (SELECT id, target FROM chats) USING (id))""",
        *all_metrics("chats", f"SELECT unnest({rouge_tokens('headline')}) AS token FROM chats UNION ALL SELECT unnest({rouge_tokens('target')}) FROM chats"),
        select=f"SELECT chat_id AS id, prompt_text, generated_text, prompt_strategy, {METRIC_COLUMNS} FROM all_scores"),
}
