"""Personal data and what gives it away, in Spark's own functions only.

Base: patterns for e-mail, IP, card and phone numbers. Beyond them, terms that reveal a protected value:
all mentions of a value (an entity) have words around them; where a word of the corpus stands nearly always beside
one entity, reading it tells which entity is meant. How much it tells is their pointwise mutual information,
log2(p(entity | word) / p(entity)), as a part of the entity's own information -log2 p(entity). Terms above a first
threshold are generalised to their kind, above a second one removed, wherever they stand. An entity and a word must
meet in several different surroundings, so that copies of one text never make its words revealing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.sources.staging import stage

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, written so that no search goes back: runs are possessive, and an e-mail starts where its run starts.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap look that every text with such a match passes.
_GATES = {"email": "contains(text, '@')", "ip": "text RLIKE '[0-9][.][0-9]'", "card": r"text RLIKE '[0-9](?:[\\x20-]?[0-9]){12}'", "phone": "contains(text, '+')"}
_TERM = r"[\p{L}\p{N}]+"
SURROUND, SUPPORT, GENERALISE, REMOVE = 6, 3, 0.8, 0.95
#: Characters looked at first on each side of a mention; only the reading time depends on it.
GLANCE = 200
_BEFORE, _AFTER = "reverse(substring(text, m.start - ({n}) + 1, {n}))", "substring(text, m.stop + 1, {n})"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(digits: str) -> str:
    """SQL: whether 13 to 19 digits (left-padded to 19) pass the Luhn check."""
    value = f"lpad({digits}, 19, '0')"
    terms = []
    for i in range(19):
        d = f"cast(substr(d, {i + 1}, 1) AS int)"
        terms.append(f"({d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)" if i % 2 else d)
    return f"transform(array({value}), d -> ({' + '.join(terms)}) % 10 = 0)[0]"


def _valid(kind: str) -> str:
    digits = "regexp_replace(m.found, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(m.found, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)"
    if kind == "card":
        return f"length({digits}) BETWEEN 13 AND 19 AND {_luhn(digits)}"
    return f"length({digits}) BETWEEN 9 AND 15" if kind == "phone" else "true"


def _matches(text: str, pattern: str) -> str:
    """SQL: array<struct<start, stop, found>> of all matches, in code points."""
    return (
        f"aggregate(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (p, m) -> named_struct('gap', length(p), 'found', m)), "
        "named_struct('at', 0, 'spans', cast(array() AS array<struct<start:int,stop:int,found:string>>)), (s, x) -> named_struct("
        "'at', s.at + x.gap + coalesce(length(x.found), 0), 'spans', CASE WHEN x.found IS NULL THEN s.spans ELSE concat(s.spans, array(named_struct("
        "'start', s.at + x.gap, 'stop', s.at + x.gap + length(x.found), 'found', x.found))) END), s -> s.spans)"
    )


def with_base(docs: DataFrame, text_col: str, out: str = "base") -> DataFrame:
    """docs and the array of base spans of the text column."""
    return docs.withColumn(out, F.expr(spans_sql(text_col)))


def spans_sql(text_col: str) -> str:
    parts = []
    for kind in KINDS:
        found = _matches("text", _literal(PATTERNS[kind]))
        empty = "cast(array() AS array<struct<kind:string,start:int,stop:int,found:string>>)"
        parts.append(f"CASE WHEN {_GATES[kind]} THEN transform(filter({found}, m -> {_valid(kind)}), m -> named_struct('kind', '{kind}', 'start', m.start, 'stop', m.stop, 'found', m.found)) ELSE {empty} END")
    return f"transform(array(coalesce(`{text_col}`, '')), text -> concat({', '.join(parts)}))[0]"


def _side(read: str, there: str, words: int) -> str:
    """SQL: the text from a mention outwards up to the end of the `words`-th word, however long its words are.

    `read` takes {n} characters outwards; `there` is how many there are. A short stretch is enough where it
    shows the last word's end or is all of the text; else the whole side is read.
    """
    pattern = _literal(rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++){{0,{words}}}")
    ended = _literal(rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++){{{words}}}[^\p{{L}}\p{{N}}]")
    short = read.format(n=f"least({there}, {GLANCE})")
    return f"regexp_extract(CASE WHEN {there} <= {GLANCE} OR {short} RLIKE {ended} THEN {short} ELSE {read.format(n=there)} END, {pattern}, 0)"


def revealing_terms(found: DataFrame, support: int = SUPPORT, least: float = GENERALISE, surround: int = SURROUND) -> DataFrame:
    """term, disclosure (0 to 1): lower-cased words that reveal an entity, from all rows of found (text, base).

    A mention's surroundings are the `surround` whole words before and after it, however long. `support` different surroundings
    must hold both, and all of an entity's surroundings together must have twice the words of one, or they
    are copies of one text with a few words changed. disclosure is the largest share of an entity's information over the entities a term meets.
    """
    mentions = found.where(F.size("base") > 0).select("text", F.explode("base").alias("m"))
    word = F.lit(_TERM)
    left, right = F.lower(F.reverse(F.expr(_side(_BEFORE, "m.start", surround)))), F.lower(F.expr(_side(_AFTER, "length(text) - m.stop", surround)))
    near = mentions.select(
        F.lower("m.found").alias("entity"),
        F.slice(F.reverse(F.regexp_extract_all(left, word, F.lit(0))), 1, surround).alias("left"),
        F.slice(F.regexp_extract_all(right, word, F.lit(0)), 1, surround).alias("right"),
    ).withColumn("place", F.xxhash64("left", "right"))
    near = stage(near.select("entity", "place", F.array_distinct(F.concat("left", "right")).alias("terms")), "pii-near")
    counted = near.groupBy("entity", "place").agg(F.count("*").alias("n"), F.first("terms").alias("terms"))
    entities = counted.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("places"), F.avg(F.size("terms")).alias("size")).where(F.col("places") >= support)
    met = counted.join(entities.select("entity"), "entity", "left_semi").select("entity", "n", F.explode("terms").alias("term"))
    met = stage(met.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("places")), "pii-met")
    varied = met.groupBy("entity").agg(F.count("*").alias("words")).join(entities, "entity").where(F.col("words") >= 2 * F.col("size"))
    pairs = met.where((F.col("places") >= support) & (F.length("term") > 1)).join(varied.select("entity", "n_entity"), "entity")
    pairs = stage(pairs, "pii-pairs")
    # Words are counted where pairs ask for them: all words of all texts, summed on the map side.
    wanted = pairs.select("term").distinct()
    words = found.select(F.explode(F.regexp_extract_all(F.lower("text"), word, F.lit(0))).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term", "left_semi")
    total = found.agg(F.sum(F.regexp_count("text", word)).alias("n")).first()["n"] or 1
    own = F.lit(float(total))
    told = F.log2(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term")) * own / F.col("n_entity")) / F.log2(own / F.col("n_entity"))
    shares = pairs.join(counts, "term").withColumn("disclosure", told).where(F.col("disclosure") >= least)
    return stage(shares.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-terms")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id, the columns `keep`, text, base and spans.

    base: array<struct<kind, start, stop, found>> of the base kinds; spans: these and kinds term (generalised)
    and name (removed), which do not touch a base span. Null texts are empty. Repeated rows stay; an empty table gives no rows.
    """
    kept = [F.col(c) for c in keep]
    rows = docs.select(F.col(id_col).alias("id"), *kept, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = with_base(rows, "text")
    terms = revealing_terms(found.select("text", "base"), support)
    # Texts that hold a revealing term, by their hash: the same text has the same places.
    key = F.md5("text")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))
    holders = rows.select(key.alias("key"), F.explode(words).alias("term")).join(terms, "term").distinct()
    listed = stage(holders.groupBy("key").agg(F.collect_list(F.struct("term", "disclosure")).alias("terms")), "pii-holders")
    joined = found.withColumn("key", key).join(listed, "key", "left")
    # Only the text's own terms are looked for: words of letters and digits, so safe in a pattern.
    pattern = f"concat({_literal(r'(?iu)(?<![\p{L}\p{N}])(?:')}, array_join(terms.term, '|'), {_literal(r')(?![\p{L}\p{N}])')})"
    extra = (
        f"filter(transform({_matches('text', pattern)}, m -> named_struct('kind', get(transform(filter(terms, t -> t.term = lower(m.found)), "
        f"t -> CASE WHEN t.disclosure >= {REMOVE} THEN 'name' ELSE 'term' END), 0), 'start', m.start, 'stop', m.stop, 'found', m.found)), "
        "m -> m.kind IS NOT NULL AND NOT exists(base, b -> b.start < m.stop AND m.start < b.stop))"
    )
    return joined.select("id", *kept, "text", "base", F.expr(f"CASE WHEN terms IS NULL THEN base ELSE concat(base, {extra}) END").alias("spans")).withColumnRenamed("id", id_col)


def listed(spans: str | Column) -> Column:
    """kind:start:stop of spans, joined by commas in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sanitised(text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the earlier, then longer one."""
    return F.expr(
        f"concat_ws('', aggregate(array_sort(`{spans}`, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.stop - a.stop END), "
        "named_struct('at', 0, 'parts', cast(array() AS array<string>)), (s, x) -> CASE WHEN x.start < s.at THEN named_struct('at', greatest(s.at, x.stop), 'parts', s.parts) ELSE "
        f"named_struct('at', x.stop, 'parts', concat(s.parts, array(substring(`{text}`, s.at + 1, x.start - s.at), concat('[', x.kind, ']')))) END, "
        f"s -> concat(s.parts, array(substring(`{text}`, s.at + 1)))))"
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """docs with the text column sanitised; all rows and columns stay, a null text stays null."""
    held = [f"held_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*held)
    own, text = held[docs.columns.index(id_col)], held[docs.columns.index(text_col)]
    out = find(plain.withColumn("id_copy", F.col(own)), "id_copy", text, support, tuple(held))
    out = out.withColumn(text, F.when(F.col(text).isNotNull(), F.when(F.size("spans") > 0, sanitised("text", "spans")).otherwise(F.col("text"))))
    return out.select(*held).toDF(*docs.columns)
