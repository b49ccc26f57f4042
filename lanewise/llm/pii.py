"""Personal data by weak supervision, with DataFrame and SQL functions only.

Base spans come from four patterns and their checks (email, ip, card, phone) and always stay. Candidates
are all matches of those patterns, whether the checks pass or not, and of looser ones: spelled-out mail
addresses, national phone numbers, id numbers and secrets. Five labelers vote 1, -1 or 0 (abstain) on each:

    shape      regex: the strict form of the kind
    check      regex and arithmetic: digit sums, ranges, a mixture of letters and digits
    gazetteer  known top-level domains, issuer and country prefixes, key prefixes, forbidden number areas
    context    words before the span that announce the kind, or that speak against it
    border     what stands right after the span

Votes are counted per kind and vote pattern (3^5 at most). Expectation-maximisation over those counts, a
fold in SQL, estimates how reliable each labeler is for each kind. The resulting probabilities are the soft
labels on which the final span classifier is trained: naive Bayes over traits of the span (length, digits,
borders) and the votes. Its probability alone decides: candidates that it gives at least ``accept`` are added.
One thing isn't estimated: addresses with a part over 255, card numbers without 14 to 19 digits or a right
check digit, phone numbers without 10 to 15 digits and id numbers of areas, groups and serials that are never
issued are labelled as no personal data (``EXACT``), so mistyped ones are lost. What stands before a span counts
back to the last match of the same pattern, 40 characters at most: in a list of numbers only the first one is
announced by the word before the list.

Positions count code points, ends are exclusive. Null text: empty, no spans. Repeated rows: one result each. An
empty table gives an empty one. Spans of several kinds may overlap or be the same: all are reported, by start and
then kind, and masked together under the kinds that begin where none before goes on. Texts of any length and with
any number of matches are taken whole, in time about in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import OWN, cut, numbered, text_or_empty

KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE = KINDS[:4]
ACCEPT = 0.9
ITERATIONS = 15
LABELERS = ("shape", "check", "gazetteer", "context", "border")
#: Kinds whose check is what they are by definition: where it fails, the label is known and not estimated.
EXACT = ("ip", "card", "phone", "id")

# The base patterns; a run is tried from its first character (or where the last match ended), and what it
# has taken isn't given back, which finds the same matches as plain backtracking in linear time.
_MAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: (kind, pattern, what a text must have for it to be looked for)
PATTERNS = (
    ("email", _MAIL, "instr(text, '@') > 0"),
    ("ip", _IP, r"text rlike '[0-9]\\.[0-9]'"),
    ("card", _CARD, r"text rlike '[0-9][ -]?[0-9]'"),
    ("phone", _PHONE, "instr(text, '+') > 0"),
    ("email", r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63}+ ?[\[(]at[\])] ?[a-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[a-z0-9-]{1,63}+)++", "text rlike '(?i)[\\\\[(]at[\\\\])]'"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9.-])", r"text rlike '[0-9]{3}[-.][0-9]{4}'"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"text rlike '[0-9]-[0-9]{2}-[0-9]{4}'"),
    ("secret", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s{0,4}[=:]\s{0,4}\"?[A-Za-z0-9+/_.~-]{8,}+\"?", "text rlike '[=:]'"),
    ("secret", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "text rlike 'A[KS]IA'"),
)

# Gazetteers, fixed values.
DOMAINS = "com org net edu gov mil int info biz eu io uk de fr es it nl be ch at pl pt se no fi dk ie us ca mx br ar au nz jp cn in".split()
COUNTRIES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420".split()
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|36|38|35|6011|64|65)"
SECRETS = "(AKIA|ASIA|ghp_|xox|sk-|eyJ)"
ANNOUNCE = {
    "email": "mail|contact|write|reach|schreib|correo|courriel",
    "ip": "host|server|address|client|login|peer|adresse|ip",
    "card": "card|visa|master|amex|payment|karte|carte|tarjeta|pan",
    "phone": "phone|tel|call|mobile|fax|cell|ruf|whatsapp|sms",
    "id": "ssn|social|security|insured|identity",
    "secret": "login|credential|secret|access|auth|key",
}
AGAINST = "(?i)(version|licen[sc]e|isbn|issn|rfc|chapter|section|article|page|v)\\W{0,3}$"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches that one fold takes; more are dealt into runs of so many, since a fold copies what it has.
RUN = 256


def _matches(kind: str, pattern: str, guard: str) -> str:
    """SQL: all matches with their places, in one array; the places are the sums of what stands between the matches and the matches."""
    p = _sql(pattern)
    item = f"named_struct('start', s.at + length(x.p[i]), 'end', s.at + length(x.p[i]) + length(x.h[i]), 'kind', '{kind}', 'found', x.h[i], 'before', right(x.p[i], 40), 'after', left(x.p[i + 1], 1))"
    kind_of = "array<struct<start:int,end:int,kind:string,found:string,before:string,after:string>>"
    run = lambda b: f"sequence({b} * {RUN}, least(size(x.h), ({b} + 1) * {RUN}) - 1)"
    length = f"aggregate({run('b')}, 0, (n, i) -> n + length(x.p[i]) + length(x.h[i]))"
    begins = f"aggregate(sequence(0, CAST(ceil(size(x.h) / {RUN}) AS INT) - 1), named_struct('at', 0, 'out', cast(array() AS array<int>)), (s, b) -> named_struct('at', s.at + {length}, 'out', concat(s.out, array(s.at))), s -> s.out)"
    fold = f"""flatten(transform({begins}, (begin, b) -> aggregate({run('b')}, named_struct('at', begin, 'out', cast(array() AS {kind_of})),
        (s, i) -> named_struct('at', s.at + length(x.p[i]) + length(x.h[i]), 'out', concat(s.out, array({item}))), s -> s.out)))"""
    both = f"array(named_struct('h', regexp_extract_all(text, {p}, 0), 'p', split(text, {p}, -1)))"
    return f"CASE WHEN {guard} THEN transform({both}, x -> CASE WHEN size(x.h) > 0 THEN {fold} ELSE cast(array() AS {kind_of}) END)[0] ELSE cast(array() AS {kind_of}) END"


_DIGITS = "regexp_replace({x}.found, '[^0-9]', '')"


def _passes(x: str) -> str:
    """SQL: whether a match of a base pattern passes its kind's check."""
    digits = _DIGITS.format(x=x)
    return f"""CASE {x}.kind WHEN 'email' THEN true
        WHEN 'ip' THEN forall(split({x}.found, '[.]'), part -> part rlike '^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')
        WHEN 'card' THEN length({digits}) BETWEEN 14 AND 19 AND luhn_check({digits})
        ELSE length({digits}) BETWEEN 10 AND 15 END"""


def found(docs: DataFrame) -> DataFrame:
    """_row, doc_id, base (spans that stay) and others (candidates that aren't among them) of every row."""
    texts = docs.select("_row", "doc_id", text_or_empty(docs).alias("text"))
    columns = [F.expr(_matches(*p)).alias(f"m{i}") for i, p in enumerate(PATTERNS)]
    each = texts.select("_row", "doc_id", *columns)
    base = f"concat({', '.join(f'm{i}' for i in range(len(BASE)))})"
    loose = f"concat({', '.join(f'm{i}' for i in range(len(BASE), len(PATTERNS)))})"
    rank = f"CAST(array_position(array({', '.join(map(_sql, KINDS))}), x.kind) AS INT)"
    return each.select(
        "_row",
        "doc_id",
        F.expr(f"transform(filter({base}, x -> {_passes('x')}), x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', x.kind, 'found', x.found, 'before', x.before, 'after', x.after))").alias("base"),
        F.expr(f"concat(filter({base}, x -> NOT ({_passes('x')})), {loose})").alias("others"),
    )


def _votes(c: DataFrame) -> DataFrame:
    """Adds v, the five votes of each candidate."""
    kind, what, digits = F.col("kind"), F.col("found"), F.regexp_replace("found", "[^0-9]", "")
    n = F.length(digits)

    def by_kind(rules: dict[str, Column]) -> Column:
        out = F.lit(0)
        for k, rule in rules.items():
            out = F.when(kind == k, rule).otherwise(out)
        return out

    def sure(condition: Column, no: int = -1) -> Column:
        return F.when(condition, F.lit(1)).otherwise(F.lit(no))

    last = F.lower(F.regexp_extract(what, r"([A-Za-z0-9-]+)[\])]?$", 1))
    value = F.regexp_extract(what, r"([A-Za-z0-9+/_.~-]+)\"?$", 1)
    shape = by_kind({
        "email": sure(what.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(@| ?[\[(]at[\])] ?).*[A-Za-z]{2,}[\])]?$")),
        "ip": sure(what.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")),
        "card": sure(what.rlike(r"^([0-9]{14,19}|[0-9]{4}([ -][0-9]{4}){2,3}([ -][0-9]{1,3})?)$")),
        "phone": sure(what.rlike(r"^(\+[0-9]{1,3}[ .-]?)?(\([0-9]{1,4}\)|[0-9]{2,4})([ .-]?[0-9]{2,4}){2,4}$")),
        "id": sure(what.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "secret": sure(F.length(value) >= 12),
    })
    check = by_kind({
        "email": sure(~what.rlike(r"\.\.|^[.-]|-\.")),
        "ip": sure(F.forall(F.split(what, "[.]"), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))),
        "card": sure((n >= 14) & (n <= 19) & F.call_function("luhn_check", digits)),
        "phone": sure((n >= 10) & (n <= 15)),
        "id": sure(~digits.rlike("^(000|666|9)|^...00|0000$")),
        "secret": sure(value.rlike("[0-9]") & value.rlike("[A-Za-z]")),
    })
    gazetteer = by_kind({
        "email": sure(last.isin(DOMAINS), 0),
        "ip": F.when(what.rlike(r"^(0|127|255)\."), -1).otherwise(F.lit(0)),
        "card": sure(digits.rlike(ISSUERS)),
        "phone": F.when(what.rlike(rf"^\+({'|'.join(sorted(COUNTRIES, key=len, reverse=True))})"), 1).otherwise(F.lit(0)),
        "id": F.when(digits.rlike("^(123456789|987654321|(.)\\2+$)"), -1).otherwise(F.lit(0)),
        "secret": F.when(what.rlike(SECRETS), 1).otherwise(F.lit(0)),
    })
    announced = by_kind({k: F.when(F.col("before").rlike(f"(?i)\\b({words})\\w{{0,12}}\\W{{0,6}}(\\w+\\W+){{0,2}}$"), 1).otherwise(F.lit(0)) for k, words in ANNOUNCE.items()})
    announced = F.when((kind == "secret") & what.rlike("[=:]"), 1).otherwise(announced)
    context = F.when(F.col("before").rlike(AGAINST), -1).otherwise(announced)
    inside = F.col("after").rlike("[A-Za-z0-9_]") | ((kind != "secret") & (F.col("after") == "@"))  # a password may go on with @
    border = F.when(inside, -1).otherwise(F.when(F.coalesce("after", F.lit("")).rlike(r"^[\s,;.!?)]?$"), 1).otherwise(F.lit(0)))
    return c.withColumn("v", F.array(*[x.cast("int") for x in (shape, check, gazetteer, context, border)]))


def _known_not(votes: str) -> str:
    """SQL: whether the check of an exact kind has failed."""
    return f"kind IN ({', '.join(map(_sql, EXACT))}) AND {votes}[{LABELERS.index('check')}] = -1"


def _estimated(patterns: DataFrame) -> DataFrame:
    """kind, model (prior, yes, no): reliabilities by expectation-maximisation over kind, v and n.

    yes[l][v + 1] is the probability that labeler l votes v on personal data, no[l][v + 1] that it does on other spans.
    """
    per_kind = patterns.groupBy("kind").agg(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n"))).alias("patterns"))  # 3^5 entries at most
    k = len(LABELERS)
    table = lambda row: f"array_repeat(array({', '.join(f'{x}D' for x in row)}), {k})"
    start = f"named_struct('prior', 0.5D, 'yes', {table((0.1, 0.2, 0.7))}, 'no', {table((0.7, 0.2, 0.1))})"
    product = lambda side: f"aggregate(sequence(0, {k - 1}), 1D, (a, l) -> a * s.{side}[l][p.v[l] + 1])"
    shares = f"transform(patterns, p -> named_struct('v', p.v, 'n', p.n, 'a', CASE WHEN {_known_not('p.v')} THEN 0D ELSE s.prior * {product('yes')} END, 'b', (1 - s.prior) * {product('no')}))"
    parts = f"transform({shares}, q -> named_struct('v', q.v, 'yes', q.n * q.a / (q.a + q.b), 'no', q.n * q.b / (q.a + q.b)))"
    total = lambda side, where="": f"aggregate({'filter(r, q -> ' + where + ')' if where else 'r'}, 0D, (a, q) -> a + q.{side})"
    rates = lambda side: f"transform(sequence(0, {k - 1}), l -> transform(sequence(-1, 1), w -> (1 + {total(side, 'q.v[l] = w')}) / (3 + {total(side)})))"
    step = f"transform(array({parts}), r -> named_struct('prior', (1 + {total('yes')}) / (2 + {total('yes')} + {total('no')}), 'yes', {rates('yes')}, 'no', {rates('no')}))[0]"
    return per_kind.select("kind", F.expr(f"aggregate(sequence(1, {ITERATIONS}), {start}, (s, i) -> {step})").alias("model"))


def _log_odds() -> Column:
    """Of a candidate's votes under its kind's model: the label that the classifier learns."""
    votes = F.expr(f"aggregate(sequence(0, {len(LABELERS) - 1}), 0D, (a, l) -> a + ln(model.yes[l][v[l] + 1] / model.no[l][v[l] + 1]))")
    return F.when(F.expr(_known_not("v")), F.lit(-100.0)).otherwise(F.ln(F.col("model.prior") / (1 - F.col("model.prior"))) + votes)


def _features(c: DataFrame) -> DataFrame:
    """Adds f: named traits of each span, from its length, characters and borders, and its votes."""
    n = F.length("found")
    share = F.round(4 * F.length(F.regexp_replace("found", "[^0-9]", "")) / n).cast("int")
    edge = lambda x: F.when(x.rlike("[A-Za-z0-9]"), "word").when(x.rlike(r"\s"), "space").when(F.coalesce(x, F.lit("")) == "", "end").otherwise("mark")
    traits = {"length": F.least(F.floor(n / 4), F.lit(16)).cast("int"), "digits": share, "left": edge(F.right("before", F.lit(1))), "right": edge(F.col("after")), "first": edge(F.left("found", F.lit(1))), "breaks": F.least(F.length(F.regexp_replace("found", r"[^\s.()@:=\"-]", "")), F.lit(8))}
    traits |= {name: F.get("v", F.lit(i)) for i, name in enumerate(LABELERS)}
    return c.withColumn("f", F.array(*[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in traits.items()]))


def added(cases: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Candidates (_row, start, end, kind, fixed, found, before, after) that aren't fixed and that the trained classifier takes for personal data."""
    voted = cut(_features(_votes(cases)), "votes")
    model = cut(_estimated(voted.groupBy("kind", "v").agg(F.count("*").alias("n"))), "model")  # a row per kind
    soft = voted.join(F.broadcast(model), "kind").withColumn("p", 1 / (1 + F.exp(-_log_odds())))
    by_kind = cut(_trained(soft), "weights")  # a row per kind, some 80 weights in it
    evidence = F.aggregate("f", F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at("weights", x), F.lit(0.0)))
    odds = F.when(F.expr(_known_not("v")), F.lit(-100.0)).otherwise(F.col("bias") + evidence)
    scored = voted.where(~F.col("fixed")).join(F.broadcast(by_kind), "kind").withColumn("probability", 1 / (1 + F.exp(-odds)))
    return scored.where(F.col("probability") >= accept).select("_row", "start", "end", "kind", "probability")


#: How many values each trait can have; a vote has three.
VALUES = {"length": 17, "digits": 5, "left": 4, "right": 4, "first": 4, "breaks": 9} | dict.fromkeys(LABELERS, 3)


def _trained(soft: DataFrame) -> DataFrame:
    """kind, bias, weights (feature -> log of how much likelier it is on personal data): naive Bayes on soft labels p, the counts of all values raised by one."""
    totals = soft.groupBy("kind").agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))
    sums = soft.select("kind", "p", F.explode("f").alias("f")).groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    values = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in VALUES.items() for x in pair]), F.substring_index("f", "=", 1)), F.lit(2))
    yes, no = (1 + F.col("yes")) / (values + F.col("all_yes")), (1 + F.col("no")) / (values + F.col("all_no"))
    entry = F.struct("f", F.ln(yes / no).alias("w"))
    return sums.join(F.broadcast(totals), "kind").groupBy("kind").agg(F.first(F.ln((1 + F.col("all_yes")) / (1 + F.col("all_no")))).alias("bias"), F.map_from_entries(F.collect_list(entry)).alias("weights"))


def _free(spans: DataFrame) -> DataFrame:
    """Adds free: whether no fixed span of the same text overlaps; two passes over a text's spans in their order."""
    upto = lambda order: Window.partitionBy("_row").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max(F.when(F.col("fixed"), F.col("end"))).over(upto(F.asc("start")))  # of those that start here or before
    begins = F.min(F.when(F.col("fixed"), F.col("start"))).over(upto(F.desc("start")))  # of those that start here or later
    return spans.withColumn("free", ~F.coalesce(ended > F.col("start"), F.lit(False)) & ~F.coalesce(begins < F.col("end"), F.lit(False)))


def personal_data(docs: DataFrame) -> DataFrame:
    """_row, doc_id, base, spans: arrays of (start, rank, end, kind), by start and kind, of every row of ``docs`` (_row, doc_id, text)."""
    kept = cut(found(docs), "found")
    slim = kept.select("_row", "doc_id", F.expr("array_sort(transform(base, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end, 'kind', x.kind)))").alias("base"))
    one = lambda column, fixed: f"transform({column}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'found', x.found, 'before', x.before, 'after', x.after, 'fixed', {fixed}))"
    each = kept.select("_row", F.explode(F.expr(f"concat({one('base', 'true')}, {one('others', 'false')})")).alias("x")).select("_row", "x.*")
    cases = _free(each).where("fixed OR free").drop("free")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    more = added(cases).groupBy("_row").agg(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind")).alias("more"))  # of one text
    return slim.join(more, "_row", "left").select("_row", "doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def _joined(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """What op1 returns, for every row of ``docs`` (doc_id, text)."""
    out = personal_data(numbered(docs.select("doc_id", "text")))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans go together. Null stays null. ``docs`` is a table as it is read."""
    row, at, own, new = (f"{OWN}{x}" for x in ("row", "at", "spans", "text"))
    rows = numbered(docs, row)
    spans = personal_data(rows.select(F.col(row).alias("_row"), "doc_id", "text")).where(F.size("spans") > 0)
    # a span that begins before all earlier ones have ended belongs to what they cover
    each = spans.select("_row", F.explode("spans").alias("x")).select("_row", "x.start", "x.end", "x.rank", "x.kind")
    before = Window.partitionBy("_row").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("past", F.coalesce(F.max("end").over(before), F.lit(0))).groupBy("_row")
    holes = each.agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("past"), F.struct("start", "past", "kind")))).alias("holes"), F.max("end").alias("last"))  # of one text
    holes = holes.select(F.col("_row").alias(at), F.struct("holes", "last").alias(own))
    # four bytes a character, so that a part is found without going through what stands before it; a mark in front keeps a part's own first character
    wide = "encode(text, 'UTF-32')"
    part = lambda start, n: f"decode(concat(X'0000FEFF', substring(w, 4 * {start} + 1, 4 * ({n}))), 'UTF-32')"
    out = F.expr(f"""transform(array({wide}), w -> concat(array_join(transform({own}.holes, x -> concat({part('x.past', 'x.start - x.past')}, '[', upper(x.kind), ']')), ''),
        {part(f'{own}.last', f'length(text) - {own}.last')}))[0]""")
    names = docs.columns
    joined = rows.join(holes, rows[row] == holes[at], "left").withColumn(new, F.when(F.col(own).isNull(), F.col("text")).otherwise(out))
    return joined.select(*[F.col(new).alias(c) if c == "text" else c for c in names])
