"""Personal data by bootstrapped contextual extraction (native)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import table, text_of
from pressloom.llm.syncmers import let
from pressloom.session import write_and_read

#: Kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive and with a guard in front (a match can only begin where a run of its characters begins
#: or where the match before it ended), which changes no match and keeps the time linear in the text.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the pattern that passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: What could be an identifier that the base patterns miss: numbers of 7 digits or more with separators, and addresses.
CANDIDATE = (
    rf"(?<![{_LOCAL}@])(?:[{_LOCAL}]{{1,64}}@[A-Za-z0-9.-]{{1,255}}|\+?\(?[0-9](?:[\x20().-]{{0,2}}[0-9]){{6,24}})(?![A-Za-z0-9@])"
)
CANDIDATE_HINT = r"@|[0-9](?:[\x20().-]{0,2}[0-9]){6}"
#: Characters on each side in which context words are looked for.
SIDE = 80
#: Matches that one step of a pass over a text's matches handles.
CHUNK = 128
#: Rounds of scoring, and what a pattern and an instance need to be believed. SMOOTHING stands for instances that
#: speak against a pattern before any is seen.
ROUNDS, BELIEVED, SEEDS, SMOOTHING = 3, 0.8, 5, 1.0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    values = F.transform(F.split(F.reverse(digits), "", -1), value)
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(found))
    if kind == "phone":
        return n.between(10, 15)
    return n.between(14, 19) & F.when(n.between(14, 19), _luhn(_digits(found))).otherwise(False)


def located(text: Column, pattern: str, hint: str) -> Column:
    """All matches in order as (start, end, found, before, after) in code points; before and after are their surroundings.

    Matches and the stretches between them come from the same search, so their lengths give the places. The running
    sum over them goes CHUNK by CHUNK, because an array that grows by one is copied each time.
    """
    kind = "array<struct<start:int,end:int,found:string,before:string,after:string>>"
    empty = F.expr(f"cast(array() as {kind})")

    def one(acc: Column, r: Column) -> Column:
        start = acc["at"] + F.length(r["g"])
        span = F.struct(
            start.alias("start"), (start + F.length(r["m"])).alias("end"), r["m"].alias("found"),
            F.right(r["g"], F.lit(SIDE)).alias("before"), F.left(r["h"], F.lit(SIDE)).alias("after"),
        )
        return F.struct((start + F.length(r["m"])).alias("at"), F.array_append(acc["out"], span).alias("out"))

    def walk(gaps: Column) -> Column:
        def zipped(found: Column) -> Column:
            rows = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.element_at(gaps, i + 1).alias("g"), F.element_at(gaps, i + 2).alias("h")))

            def chunked(rows: Column) -> Column:
                def chunk(acc: Column, c: Column) -> Column:
                    part = F.aggregate(F.slice(rows, c * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), empty.alias("out")), one)
                    return let(part, lambda p: F.struct(p["at"].alias("at"), F.array_append(acc["out"], p["out"]).alias("out")))

                start = F.expr(f"named_struct('at', 0, 'out', cast(array() as array<{kind}>))")
                return F.aggregate(_chunks(rows), start, chunk, lambda acc: F.flatten(acc["out"]))

            return let(rows, chunked)

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), zipped)

    return F.when(text.rlike(hint), let(F.split(text, pattern, -1), walk)).otherwise(empty)


def _chunks(rows: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.greatest(F.size(rows), F.lit(1)) - 1) / CHUNK).cast("int"))


def apart_from(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (in order) that touch none of ``others``: CHUNK of them at a time look at the others near them."""

    def chunk_of(spans: Column):
        def keep(c: Column) -> Column:
            def near(part: Column) -> Column:
                first, last = F.element_at(part, 1)["start"], F.element_at(part, -1)["end"]
                close = F.filter(others, lambda b: (b["start"] < last) & (first < b["end"]))
                return let(close, lambda some: F.filter(part, lambda m: ~F.exists(some, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))

            part = F.slice(spans, c * CHUNK + 1, F.lit(CHUNK))
            return F.when(F.size(spans) > 0, let(part, near)).otherwise(part)

        return keep

    return let(spans, lambda s: F.flatten(F.transform(_chunks(s), chunk_of(s))))


def _context(before: Column, after: Column) -> Column:
    """Lexical patterns of an occurrence, all within its line and each only if there: a label (one word with a mark behind
    it, as in ``tel: _``), the two words before, and the words on both sides.

    A word without a mark is no pattern by itself: ``the _`` stands before anything.
    """
    line = F.lower(before)
    label = F.regexp_extract(line, r"([\p{L}]+)[ \t]*[:=#][^\p{L}\n]*\z", 1)
    one = F.regexp_extract(line, r"([\p{L}]+)[^\p{L}\n]*\z", 1)
    ahead = F.regexp_extract(line, r"([\p{L}]+)[^\p{L}\n]+[\p{L}]+[^\p{L}\n]*\z", 1)
    behind = F.regexp_extract(F.lower(after), r"^[^\p{L}\n]*([\p{L}]+)", 1)
    return F.array_compact(F.array(
        F.when(label != "", F.concat(label, F.lit(": _"))),
        F.when(ahead != "", F.concat_ws(" ", ahead, one, F.lit("_"))),
        F.when((one != "") & (behind != ""), F.concat(one, F.lit(" _ "), behind)),
    ))


def could_be(kind: Column, found: Column) -> Column:
    """False for what its own digits refute: a card number that fails Luhn, an address with a part above 255.

    Such an instance speaks against its patterns and is never found.
    """
    refuted = F.when(kind == "card", F.length(_digits(found)).between(14, 19) & ~passes("card", found)).when(kind == "ip", ~passes("ip", found))
    return ~F.coalesce(refuted, F.lit(False))


def kind_of(found: Column) -> Column:
    """The only kind that an identifier of this shape can be."""
    n = F.length(_digits(found))
    return (
        F.when(F.contains(found, F.lit("@")), "email")
        .when(found.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
        .when(n.between(13, 19) & found.rlike(r"^[0-9\x20-]+$"), "card")
        .otherwise("phone")
    )


def instance_of(found: Column) -> Column:
    return F.when(F.contains(found, F.lit("@")), F.lower(found)).otherwise(_digits(found))


def _passing(kind: str):
    return lambda m: passes(kind, m["found"])


def _tagged(kind: str, place: int):
    return lambda m: F.struct(
        m["start"].alias("start"), F.lit(place).alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind"),
        instance_of(m["found"]).alias("instance"), _context(m["before"], m["after"]).alias("patterns"),
    )


def _of_kind(kind: str):
    return lambda b: b["kind"] == kind


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_key, doc_id, base, others``: the base matches of every text, and candidates apart from all of them."""
    text = F.col("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text")).withColumn("row_key", F.monotonically_increasing_id())
    for kind in KINDS:
        rows = rows.withColumn(kind, F.filter(located(text, PATTERNS[kind], HINTS[kind]), _passing(kind)))
    rows = rows.withColumn("maybe", located(text, CANDIDATE, CANDIDATE_HINT)).drop("text")
    tagged = [F.transform(kind, _tagged(kind, place)) for place, kind in enumerate(KINDS)]
    rows = rows.select("row_key", "doc_id", F.array_sort(F.concat(*tagged)).alias("base"), "maybe")
    others = F.transform(apart_from(F.col("maybe"), F.col("base")), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), kind_of(m["found"]).alias("kind"),
        instance_of(m["found"]).alias("instance"), _context(m["before"], m["after"]).alias("patterns"),
        could_be(kind_of(m["found"]), m["found"]).alias("possible"),
    ))
    return rows.select("row_key", "doc_id", "base", others.alias("others"))


def believed(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind, instance`` of the unseen identifiers that trusted patterns find, from ``kind, pattern, instance, seed, possible``.

    The edges are distinct, so a pattern or an instance in a third of all documents weighs as one for each partner.
    Round by round: a pattern's confidence is what its instances score over their number plus SMOOTHING, counted only
    with SEEDS seeds or more; an instance that is no seed scores as the chance that one of its patterns is right, one that is not possible scores nothing.
    """
    scored = graph.withColumn("score", F.col("seed").cast("double"))
    for number in range(rounds):
        trust = scored.groupBy("kind", "pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + SMOOTHING)).alias("trust"), F.sum(F.col("seed").cast("int")).alias("seeds")
        )
        trust = trust.where(F.col("seeds") >= SEEDS).select("kind", "pattern", F.least("trust", F.lit(0.999)).alias("trust"))
        unseen = graph.where("possible and not seed").join(trust, ["kind", "pattern"])
        found = unseen.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("found"), F.max("trust").alias("best"))
        found = write_and_read(found, f"scores-{number}")
        scored = graph.join(found.drop("best"), ["kind", "instance"], "left").withColumn(
            "score", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("found", F.lit(0.0)))
        ).drop("found")
    return found.where((F.col("found") >= BELIEVED) & (F.col("best") >= BELIEVED)).select("kind", "instance")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, base, added``, arrays of (start, place, end, kind) in code points.

    Base matches seed the extraction. The words around them become patterns; patterns and instances score each other
    over all documents, and what trusted patterns find besides is ``added``. Texts are read once; what moves between
    tasks are identifiers with their contexts, and every count is combined map-side.

    Null and empty texts have no spans. Repeated rows are rows of their own; in the scores a repeated occurrence counts
    once. A table without matches adds nothing. A very long text is searched whole, in its row: time grows with its
    length, and with its matches to the power of 1.5. Other columns are not read, whatever their names.
    """
    rows = write_and_read(occurrences(docs, id_col, text_col), "occurrences")
    seen = rows.select(F.explode("base").alias("o")).select("o.kind", "o.instance", "o.patterns", F.lit(True).alias("seed"), F.lit(True).alias("possible"))
    other = rows.select(F.explode("others").alias("o")).select("o.kind", "o.instance", "o.patterns", F.lit(False).alias("seed"), "o.possible")
    edges = seen.unionByName(other).select("kind", "instance", "seed", "possible", F.explode("patterns").alias("pattern"))
    graph = write_and_read(edges.groupBy("kind", "instance", "pattern").agg(F.max("seed").alias("seed"), F.max("possible").alias("possible")), "pattern-graph")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("o.kind")) - 1
    new = rows.select("row_key", F.explode("others").alias("o")).where("o.possible").select(
        "row_key", F.col("o.kind").alias("kind"), F.col("o.instance").alias("instance"),
        F.struct(F.col("o.start").alias("start"), place.cast("int").alias("place"), F.col("o.end").alias("end"), F.col("o.kind").alias("kind")).alias("span"),
    )
    new = new.join(believed(graph), ["kind", "instance"]).groupBy("row_key").agg(F.collect_list("span").alias("added"))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["place"].alias("place"), b["end"].alias("end"), b["kind"].alias("kind")))
    return rows.join(new, "row_key", "left").select(
        "doc_id", plain.alias("base"), F.coalesce("added", F.expr("cast(array() as array<struct<start:int,place:int,end:int,kind:string>>)")).alias("added")
    )


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir):
    """All ``documents``. The counts are those of the base matches."""
    found = extract(table(spark, sf_dir))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
