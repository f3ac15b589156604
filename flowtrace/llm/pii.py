"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Patterns propose spans: the base kinds, whose matches must pass a check (octets, Luhn, digits), and many
looser forms without one: spelt-out addresses, IPv6, cards and phones in other groupings, secrets of any
length, bank accounts, social security numbers. Boosted trees learn from planted examples, real forms in telling and neutral surroundings against
numbers and words that only look alike, and from the corpus' own base matches, passed against failed.
Thresholds are calibrated per kind on loose candidates held back. Loose spans that reach their kind's
threshold are added to the base ones, the likeliest first, none that overlaps one that stays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Base matches that trees are fitted to (about so many, by hash), and planted examples of each form.
MAX_TRAIN, PLANTED = 20_000, 160
TREES, DEPTH = 20, 4
#: Least precision of added spans among the held-back loose candidates.
PRECISION = 0.95
#: Letters seen before and after a candidate; matches placed together.
CONTEXT, AFTER, RUN = 32, 8, 512
#: Spans from which a text is taken apart into letters once, not measured anew for every span.
MANY = 64

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn")
#: The base patterns, written so that no run of letters or digits is tried from more than one place
#: and no repetition recurses; and what each kind's text must hold at all.
BASE = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9][0-9 -]{11,}", r"[0-9][0-9 -]*+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Loose forms: kind, what a text must hold at all, and the pattern.
LOOSE = (
    ("email", r"(?i)[(\[{] ?at ?[)\]}]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[(\[{] ?at ?[)\]}] ?[a-z0-9-]++(?:(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?| dot )[a-z0-9-]++)++"),
    ("email", r"(?i) at [a-z0-9-]+ dot ", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ at [a-z0-9-]++(?: dot [a-z0-9-]++)++"),
    ("ip", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ip", r"::", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?+::(?:(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}|(?<=[0-9A-Fa-f]::))(?![0-9A-Za-z:])"),
    ("card", r"[0-9]{4}[./_ -]{1,3}[0-9]{4}[./_ -]{1,3}[0-9]{4}", r"(?<![0-9.])[0-9]{4}(?:(?:[./_]| {2}| - )[0-9]{4}){2}(?:[./_]| {2}| - )[0-9]{1,7}(?![0-9]|\.[0-9])"),
    ("card", r"3[0-9]{3}[./_ -]{1,3}[0-9]{6}[./_ -]{1,3}[0-9]{5}", r"(?<![0-9.])3[0-9]{3}(?:[./_]| {2}| - )[0-9]{6}(?:[./_]| {2}| - )[0-9]{5}(?![0-9]|\.[0-9])"),
    ("phone", r"[0-9][)./ -]{1,2}[0-9]{2}", r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9A-Za-z-])"),
    ("phone", r"00[1-9]", r"(?<![0-9A-Za-z+.])00[1-9][0-9]{0,2}[ ./-]?[0-9(][0-9 ()./-]{5,16}[0-9](?![0-9A-Za-z])"),
    # values of any length; the cheap looks come first, the word that tells last
    ("secret", r"(?i)token|secret|passw|key|bearer", r"(?i)(?<=[\x20\t:=\x22\x27])(?=[A-Za-z0-9+/_=.-]{16})(?<=(?:token|secret|password|passwd|key|bearer)[\x20\t]{0,2}[:=]{0,2}[\x20\t]{0,2}[\x22\x27]{0,1})[A-Za-z0-9+/_=-]++(?:\.[A-Za-z0-9+/_=-]++)*+"),
    ("secret", r"AKIA|gh[pousr]_|sk-|xox|eyJ", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)++)"),
    ("secret", r"-----BEGIN [A-Z ]*PRIVATE KEY", r"-----BEGIN (?:[A-Z]++ )*?PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]++(?:-----END [A-Z ]++-----)?+"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("iban", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
)
#: Planted values by kind and outcome, as SQL over d (64 random digits), h (64 random hex digits), n and m (words).
_CARD = "concat('4', substr(d, 1, 14))"
_LUHN = "pmod(10 - aggregate(transform(split(reverse({0}), ''), (x, i) -> if(i % 2 = 1, int(x), if(int(x) > 4, 2 * int(x) - 9, 2 * int(x)))), 0, (a, x) -> a + x) % 10, 10)"
_GOOD = f"concat({_CARD}, {_LUHN.format(_CARD)})"
_BAD = f"concat({_CARD}, ({_LUHN.format(_CARD)} + 1 + int(substr(d, 20, 1)) % 9) % 10)"
_AMEX = "concat('37', substr(d, 1, 12))"
_AMEX_GOOD = f"concat({_AMEX}, {_LUHN.format(_AMEX)})"
#: A number's remainder by 97, letters as 10 to 35.
_MOD97 = "aggregate(split({0}, ''), 0, (a, x) -> if(x rlike '[0-9]', (a * 10 + int(x)) % 97, (a * 100 + ascii(x) - 55) % 97))"
_IN_PARTS = lambda value: f"array_join(transform(sequence(1, length({value}), 4), i -> substr({value}, i, 4)), ' ')"
_IN_FOURS = lambda value, sign: f"concat_ws('{sign}', substr({value}, 1, 4), substr({value}, 5, 4), substr({value}, 9, 4), substr({value}, 13, 4))"


def _checked(land: str, rest: str) -> str:
    """An account number whose check digits are right."""
    return f"concat('{land}', lpad(98 - {_MOD97.format(f"concat({rest}, '{land}00')")}, 2, '0'), {rest})"


PLANTS = (
    ("email", 1, "concat(n, ' [at] ', m, ' [dot] com')"), ("email", 1, "concat(n, '(at)', m, if(length(n) % 2 = 0, '.org', concat('.', n, '.com')))"), ("email", 1, "concat(n, ' at ', m, ' dot net')"), ("email", 1, "concat(n, '{at}', m, ' dot co dot uk')"), ("email", 1, "concat(n, ' AT ', m, ' DOT com')"),
    ("email", 0, "concat('met [at] ', substr(d, 1, 1), '.', substr(d, 2, 2))"), ("email", 0, "concat('look at ', if(length(n) % 2 = 0, 'this', 'the'), ' dot ', if(length(m) % 2 = 0, 'product', 'plot'))"), ("email", 0, "concat('x at ', substr(d, 1, 1), ' dot ', substr(d, 2, 1))"), ("email", 0, "concat(element_at(array('us', 'me', 'them', 'look', 'work'), 1 + int(substr(d, 1, 1)) % 5), ' at ', m, ' dot ', if(length(n) % 2 = 0, 'com', 'net'))"),
    ("ip", 1, "concat_ws(':', substr(h, 1, 4), substr(h, 5, 4), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 4), substr(h, 25, 4), substr(h, 29, 4))"), ("ip", 1, "concat('2001:', substr(h, 1, 3), '::', substr(h, 5, 2))"), ("ip", 1, "concat('fe80::', substr(h, 1, 4), ':', substr(h, 5, 4))"), ("ip", 1, "if(length(n) % 2 = 0, '::1', concat('fe80::', if(length(m) % 2 = 0, '', '1')))"), ("ip", 1, "concat('2a0', substr(d, 1, 1), ':', substr(h, 2, 4), ':', substr(d, 3, 2), '::', substr(h, 7, 4))"),
    ("ip", 0, "concat_ws(':', '1', '2', substr(d, 1, 1), '4', substr(d, 2, 1), '6', '7', substr(d, 3, 1))"), ("ip", 0, "concat(substr(d, 1, 1), '::', substr(d, 2, 1))"), ("ip", 0, "concat(substr('abcdef', 1 + int(substr(d, 1, 1)) % 5, 1), '::', substr('abcdef', 1 + int(substr(d, 2, 1)) % 5, 1))"),
    *(("card", 1, _IN_FOURS(_GOOD, sign)) for sign in (".", "/", " - ")), *(("card", 0, _IN_FOURS(_BAD, sign)) for sign in (".", "/", " - ")), ("card", 1, f"concat_ws('.', substr({_AMEX_GOOD}, 1, 4), substr({_AMEX_GOOD}, 5, 6), substr({_AMEX_GOOD}, 11, 5))"), ("card", 0, "concat_ws('.', concat('3', substr(d, 1, 3)), substr(d, 5, 6), substr(d, 11, 5))"),
    ("phone", 1, "concat('(', substr(d, 1, 3), ') ', substr(d, 4, 3), '-', substr(d, 7, 4))"), ("phone", 1, "concat_ws('-', substr(d, 1, 3), substr(d, 4, 3), substr(d, 7, 4))"), ("phone", 1, "concat_ws('.', substr(d, 1, 3), substr(d, 4, 3), substr(d, 7, 4))"),
    ("phone", 1, "concat('0', substr(d, 1, 3), ' ', substr(d, 4, 3), ' ', substr(d, 7, 4))"), ("phone", 1, "concat('0', substr(d, 1, 2), '/', substr(d, 3, 3), ' ', substr(d, 6, 2), ' ', substr(d, 8, 2))"), ("phone", 1, "concat('0044 20 ', substr(d, 1, 4), ' ', substr(d, 5, 4))"), ("phone", 1, "concat('0033 ', 1 + int(substr(d, 9, 1)) % 6, ' ', substr(d, 1, 2), ' ', substr(d, 3, 2), ' ', substr(d, 5, 2), ' ', substr(d, 7, 2))"),
    ("phone", 0, "concat('20', substr(d, 1, 2), '-0', 1 + int(substr(d, 3, 1)) % 9, '-1', substr(d, 4, 1))"), ("phone", 0, "concat('1', int(substr(d, 1, 1)) % 3, '.0', 1 + int(substr(d, 2, 1)) % 9, '.20', substr(d, 3, 2))"), ("phone", 0, _IN_FOURS(_BAD, ".")), ("phone", 0, _IN_FOURS(_BAD, "/")), ("phone", 0, "concat_ws('-', '978', substr(d, 2, 2), substr(d, 4, 3), substr(d, 7, 3))"),
    ("phone", 0, "concat_ws(' ', concat(1 + int(substr(d, 1, 1)) % 9, '00'), concat(1 + int(substr(d, 2, 1)) % 9, '00'), concat(1 + int(substr(d, 3, 1)) % 9, '00'))"), ("phone", 0, "concat_ws('.', concat(1 + int(substr(d, 1, 1)) % 9, substr(d, 2, 1)), substr(d, 3, 3), substr(d, 6, 3))"),
    ("secret", 1, "concat('token = \"', substr(h, 1, 40), '\"')"), ("secret", 1, "concat('api_key: ', substr(base64(unhex(h)), 1, 32))"), ("secret", 1, "concat('password=', n, substr(h, 1, 12), m)"), ("secret", 1, "concat('AKIA', upper(substr(translate(h, '0123456789', 'GHJKLMNPQR'), 1, 16)))"), ("secret", 1, "concat('ghp_', substr(base64(unhex(h)), 1, 10), substr(h, 1, 26))"),
    ("secret", 1, "concat('secret = \"', h, h, substr(base64(unhex(h)), 1, 40), '\"')"), ("secret", 1, "concat('bearer eyJ', substr(base64(unhex(h)), 1, 30), '.', substr(base64(unhex(reverse(h))), 1, 40), '.', substr(h, 3, 43))"), ("secret", 1, "concat('-----BEGIN PRIVATE KEY-----\n', base64(unhex(concat(h, h))), '\n-----END PRIVATE KEY-----')"),
    ("secret", 0, "concat('key: ', n, '_', m, '_identifier_column')"), ("secret", 0, "concat('token = ', repeat(substr(h, 1, 1), 24))"), ("secret", 0, "concat('secret ', n, '-', m, '-', n, '-of-', m)"), ("secret", 0, "'password_must_be_changed_often'"),
    *(("iban", 1, form(_checked(land, rest))) for form in (_IN_PARTS, str) for land, rest in (("DE", "substr(d, 3, 18)"), ("FR", "concat(substr(d, 1, 20), 'A', substr(d, 23, 2))"), ("GB", "concat('NWBK', substr(d, 3, 14))"))),
    ("iban", 0, "concat('PN', substr(d, 1, 2), ' ', upper(substr(translate(h, '0123456789', 'GHJKLMNPQR'), 1, 4)), ' ', substr(d, 3, 4), ' ', upper(substr(translate(h, '0123456789', 'GHJKLMNPQR'), 5, 4)))"), ("iban", 0, "concat('XK', substr(d, 1, 20))"),
    ("ssn", 1, "concat_ws('-', substr(d, 1, 3), substr(d, 4, 2), substr(d, 6, 4))"), ("ssn", 0, "concat_ws('-', substr(d, 1, 3), substr(d, 4, 2), substr(d, 6, 4))"),
)
#: What stands before planted values: for real ones words that tell, for lookalikes words that tell otherwise, for both neutral ones.
LEADS = {
    "email": ("write to", "contact", "mail me:", "e-mail"), "ip": ("host", "server address", "connect from", "ip"), "card": ("card number", "pay by visa", "credit card:", "my card is"), "phone": ("call me on", "tel.", "phone:", "mobile"),
    "secret": ("", "use", "config:", "set"), "iban": ("account", "iban:", "bank transfer to", "pay into"), "ssn": ("ssn", "social security number", "SSN:", "tax id"), "": ("and then", "the", "so", "of a"), "not": ("order", "on the date", "page", "version", "item no.", "ratio", "section", "invoice"),
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_SPAN = "struct<start:int,end:int,hit:string,before:string,after:string>"
_DIGITS = "regexp_replace(c.hit, '[^0-9]', '')"
_SUM = f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> if(i % 2 = 0, int(d), if(int(d) > 4, 2 * int(d) - 9, 2 * int(d)))), 0, (a, d) -> a + d)"
_MOVED = "concat(substr(regexp_replace(c.hit, '[^A-Z0-9]', ''), 5), substr(regexp_replace(c.hit, '[^A-Z0-9]', ''), 1, 4))"
#: What the trees see of a candidate c, by SQL.
FEATURES = (
    "c.form",
    "length(c.hit)",
    f"length({_DIGITS})",
    "length(regexp_replace(c.hit, '[^A-Za-z]', ''))",
    "length(regexp_replace(c.hit, '[^ ().-]', ''))",
    "size(split(c.hit, '[^0-9A-Za-z]+', -1))",
    "if(c.kind = 4, size(array_distinct(split(left(c.hit, 64), ''))), 0)",
    f"int(c.kind = 2 AND length({_DIGITS}) BETWEEN 13 AND 19 AND {_SUM} % 10 = 0)",
    "int(c.hit rlike '^(19|20)[0-9]{2}[ ./-]' OR c.hit rlike '[ ./-](19|20)[0-9]{2}$')",
    "int(c.hit rlike '^97[89]')",
    "int(c.hit rlike '^0')",
    "int(c.hit rlike '0 [0-9]*0 ')",
    "int(right(c.before, 1) rlike '[0-9A-Za-z]')",
    "int(right(c.before, 1) rlike '[^0-9A-Za-z\\\\s]')",
    "int(c.after rlike '^[0-9A-Za-z]')",
    "int(c.after rlike '^[^0-9A-Za-z\\\\s]')",
    "int(lower(c.before) rlike 'mail|contact|write|reach')",
    "int(lower(c.before) rlike 'phone|tel|call|fax|mobil|cell')",
    "int(lower(c.before) rlike 'card|visa|credit|debit|amex')",
    "int(lower(c.before) rlike 'ip|host|server|connect|addr')",
    "int(lower(c.before) rlike 'token|secret|key|passw|bearer')",
    "int(lower(c.before) rlike 'iban|bank|account|konto')",
    "int(lower(c.before) rlike 'ssn|social|tax')",
    f"int(if(c.kind = 5, {_MOD97.format(_MOVED)} = 1, false))",
    "int(c.kind = 0 AND (c.hit rlike '[(\\\\[{]' OR c.hit rlike ' AT .* DOT '))",
    "int(c.kind = 0 AND lower(c.hit) rlike '^(us|me|you|him|her|it|them|this|that|look|met|here|there|home|work|are|is|was|be) at ')",
    "int(c.hit rlike '^[0-9]{4}[^0-9]+[0-9]{4}[^0-9]+[0-9]{4}')",
    "int(lower(c.before) rlike 'order|invoice|version|isbn|page|date|item|section|ratio|commit|part')",
)


def _found(text: str, gate: str, pattern: str) -> tuple[Column, Column]:
    """What lies between the matches of pattern, and the matches; a cheap look decides whether to search at all."""
    none, wanted = F.array().cast("array<string>"), F.col(text).rlike(gate)
    return F.when(wanted, F.split(F.col(text), pattern, -1)).otherwise(none), F.when(wanted, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none)


def _spans(gaps: str, hits: str) -> Column:
    """Matches with their places in code points and what stands before and after them, RUN matches at a time."""
    runs = f"sequence(0, greatest(0, size({hits}) - 1) div {RUN})"
    inner = f"""aggregate(sequence(b * {RUN}, least(size({hits}), (b + 1) * {RUN}) - 1),
          named_struct('at', 0, 'out', cast(array() AS array<{_SPAN}>)),
          (acc, i) -> named_struct('at', acc.at + length(get({gaps}, i)) + length(get({hits}, i)), 'out', array_append(acc.out, cast(named_struct(
            'start', acc.at + length(get({gaps}, i)), 'end', acc.at + length(get({gaps}, i)) + length(get({hits}, i)), 'hit', get({hits}, i),
            'before', concat(if(length(get({gaps}, i)) < 4 AND i > 0, right(get({hits}, i - 1), 4), ''), right(get({gaps}, i), {CONTEXT})), 'after', left(get({gaps}, i + 1), {AFTER})) AS {_SPAN}))))"""
    moved = "transform(r.out, c -> named_struct('start', c.start + acc.at, 'end', c.end + acc.at, 'hit', c.hit, 'before', c.before, 'after', c.after))"
    return F.expr(f"""if(size({hits}) = 0, cast(array() AS array<{_SPAN}>), flatten(aggregate(transform({runs}, b -> {inner}),
        named_struct('at', 0, 'out', cast(array() AS array<array<{_SPAN}>>)),
        (acc, r) -> named_struct('at', acc.at + r.at, 'out', array_append(acc.out, {moved})), acc -> acc.out)))""")


def _passes(kind: str) -> str:
    """SQL for whether a base match c passes its kind's check."""
    octets = rf"^{_OCTET}(?:\\.{_OCTET}){{3}}$"
    return {"email": "true", "ip": f"c.hit rlike '{octets}'", "card": f"if(length({_DIGITS}) BETWEEN 13 AND 19, {_SUM} % 10 = 0, false)", "phone": f"length({_DIGITS}) BETWEEN 9 AND 15"}[kind]


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _text (null: empty), _base and _loose: spans by kind with their check's outcome and the trees' features."""
    text = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    # a space or hyphen that isn't between digits can't be part of a card number
    text = text.withColumn("_digits", F.when(F.col("_text").rlike(BASE["card"][0]), F.regexp_replace("_text", r"(?<![0-9])[ -]|[ -](?![0-9])", "\u0001")).otherwise(""))
    forms = [(f"_base{k}", BASE_KINDS.index(kind), k, "_digits" if kind == "card" else "_text", *BASE[kind], _passes(kind)) for k, kind in enumerate(BASE_KINDS)]
    forms += [(f"_loose{k}", KINDS.index(kind), len(BASE) + k, "_text", gate, pattern, "false") for k, (kind, gate, pattern) in enumerate(LOOSE)]
    found: dict[str, Column] = {}
    for name, _, _, source, gate, pattern, _ in forms:
        found[f"{name}_gaps"], found[f"{name}_hits"] = _found(source, gate, pattern)
    placed = text.withColumns(found).withColumns({name: _spans(f"{name}_gaps", f"{name}_hits") for name, *_ in forms})
    slim = lambda group: ", ".join(f"transform({name}, c -> struct({kind} AS kind, {form} AS form, c.start, c.end, c.hit, c.before, c.after, {check} AS passed))" for name, kind, form, _, _, _, check in forms if name.startswith(group))
    listed = placed.withColumns({g: F.expr(f"concat({slim(g)})") for g in ("_base", "_loose")})
    feature = ", ".join(f"double({f})" for f in FEATURES)
    seen = listed.withColumns({g: F.expr(f"transform({g}, c -> struct(c.kind, c.start, c.end, c.passed, array({feature}) AS f))") for g in ("_base", "_loose")})
    return seen.select(*docs.columns, "_text", "_base", "_loose")


def planted(spark: SparkSession, each: int = PLANTED) -> DataFrame:
    """(text, kind, real, from, to): made-up examples, each of every planted value, in telling and neutral surroundings."""
    # nothing but what stands before it tells a social security number
    rows = [(KINDS.index(kind), real, k, [*LEADS[kind if real else "not"], *(LEADS[""] if kind != "ssn" or not real else ())]) for k, (kind, real, _) in enumerate(PLANTS)]
    kinds = spark.createDataFrame(rows, "kind int, real int, plant int, leads array<string>")
    made = kinds.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    made = made.withColumn("h", F.sha2(F.concat_ws(":", "plant", "no").cast("binary"), 256)).withColumn("d", F.translate("h", "abcdef", "357914"))
    word = lambda at, n: F.translate(F.substr("h", F.lit(at), n), "0123456789abcdef", "aeioubdglmnrstpk")
    size = lambda k: F.lit(3) + F.pmod(F.xxhash64("no", "plant", F.lit(k)), F.lit(7)).cast("int")
    name = F.when(F.col("no") % 3 == 0, word(41, size(0))).when(F.col("no") % 3 == 1, F.concat(F.substring("h", 40, 1), F.lit("."), word(42, size(1)))).otherwise(F.concat(word(41, size(2)), F.substring("d", 50, 2)))
    made = made.withColumn("n", F.when(F.col("kind") == 0, name).otherwise(word(41, size(0)))).withColumn("m", word(51, size(3)))
    value = F.expr("CASE plant " + " ".join(f"WHEN {k} THEN {sql}" for k, (_, _, sql) in enumerate(PLANTS)) + " END")
    lead = F.concat("m", F.lit(" "), F.element_at("leads", (F.col("no") % F.size("leads") + 1).cast("int")), F.lit(" "))
    tail = F.element_at(F.array(*map(F.lit, (".", " and so on", ",", "", " ("))), (F.col("no") % 5 + 1).cast("int"))
    made = made.withColumn("lead", lead).withColumn("value", value)
    return made.select(F.concat("lead", "value", tail).alias("text"), "kind", "real", F.length("lead").alias("from"), (F.length("lead") + F.length("value")).alias("to"))


@dataclass
class Redactor:
    """Fitted trees as nested conditions over a candidate's features, and the kinds' thresholds."""

    trees: list[str] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def chance(self, c: str) -> str:
        """SQL for the probability that candidate c is personal data."""
        margin = " + ".join(t.replace("c.f[", f"{c}.f[") for t in self.trees) or "-1D"
        return f"(1D / (1D + exp(-2D * ({margin}))))"

    def added(self) -> Column:
        """The loose candidates that reach their kind's threshold, with their probability p."""
        limit = "CASE c.kind " + " ".join(f"WHEN {i} THEN {self.thresholds.get(k, 2.0)}D" for i, k in enumerate(KINDS)) + " END"
        return F.expr(f"filter(transform(_loose, c -> struct(c.kind, c.start, c.end, {self.chance('c')} AS p)), c -> c.p >= {limit})")


def _condition(node) -> str:
    """A tree's node as SQL over c.f."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    split = node.split()
    return f"if(c.f[{split.featureIndex()}] <= {split.threshold()!r}D, {_condition(node.leftChild())}, {_condition(node.rightChild())})"


def _found_plants(plants: DataFrame) -> DataFrame:
    """Of planted() examples the loose candidates c that overlap the planted value and are of its kind."""
    plants = candidates(plants).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(4)))
    # before an inner explode Spark puts a filter that holds all of the candidates' SQL again
    return plants.select("kind", "real", "from", "to", "fold", F.explode_outer("_loose").alias("c")).where("c.kind = kind AND c.start < to AND from < c.end")


def fit(found: DataFrame, max_train: int = MAX_TRAIN) -> Redactor:
    """Trees and thresholds from planted examples and candidates()'s base matches (an empty table leaves the planted ones)."""
    model = Redactor()
    matches = found.select(F.explode("_base").alias("c")).select("c.kind", "c.passed", "c.f", F.xxhash64("c.f", "c.kind", "c.start").alias("hash"))
    share = min(1.0, max_train / max(1, matches.count()))
    own = matches.where(F.pmod("hash", F.lit(1 << 20)) < int(share * (1 << 20))).select("kind", "passed", "f", F.lit(1).alias("fold"))
    plants = cut(_found_plants(cut(planted(found.sparkSession).repartition(4))).select("kind", (F.col("real") == 1).alias("passed"), "c.f", F.col("fold").cast("int")))
    train = own.union(plants.where("fold > 0")).select(array_to_vector("f").alias("features"), F.col("passed").cast("double").alias("label"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64).fit(cut(train.coalesce(4)))
    model.trees = [f"{w!r}D * {_condition(t._java_obj.rootNode())}" for t, w in zip(trees.trees, trees.treeWeights)]
    scored = plants.where("fold = 0").select("kind", "passed", F.struct("f").alias("c")).select("kind", "passed", F.floor(F.expr(model.chance("c")) * 100).alias("bin"))
    bins = scored.groupBy("kind", "bin").agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("int")).alias("good")).collect()  # 101 bins a kind
    for i, kind in enumerate(KINDS):
        n = good = 0
        own = sorted((r for r in bins if r.kind == i), key=lambda r: -r.bin)
        for r, below in zip(own, [*[r.bin for r in own[1:]], 0]):
            n, good = n + r.n, good + r.good
            if good >= PRECISION * n:
                # halfway to the next lower probability that was seen
                model.thresholds[kind] = (r.bin + below) / 200
    return model


_KEPT = "struct<p:double,kind:int,start:int,end:int>"
#: Candidates in order of start, as runs in which each overlaps one before it.
_RUNS = """aggregate({all}, named_struct('end', -1, 'open', cast(array() AS array<{kept}>), 'done', cast(array() AS array<array<{kept}>>)),
    (acc, c) -> if(c.start < acc.end, named_struct('end', greatest(acc.end, c.end), 'open', array_append(acc.open, {c}), 'done', acc.done),
      named_struct('end', c.end, 'open', array({c}), 'done', if(size(acc.open) > 0, array_append(acc.done, acc.open), acc.done))),
    acc -> array_append(acc.done, acc.open))"""
#: Of a run r the likeliest first, without what overlaps one that stays; base spans (p 2) all stay.
_CHOSEN = """if(size(r) = 1, r, aggregate(array_sort(r, (a, b) -> if(a.p > b.p, -1, if(a.p < b.p, 1, if(a.start < b.start, -1, if(a.start > b.start, 1, if(a.end < b.end, -1, if(a.end > b.end, 1, a.kind - b.kind))))))),
    cast(array() AS array<{kept}>), (acc, c) -> if(c.p < 2 AND exists(acc, k -> k.start < c.end AND c.start < k.end), acc, array_append(acc, {c}))))"""


def spans(found: DataFrame, model: Redactor) -> DataFrame:
    """found with _base_spans and _all_spans: arrays of (kind number, start, end), in order of kind and start.

    Base spans stay. Of the others the likeliest come first (of equals the first in the text), and what overlaps one that stays is
    left out; only a run of overlapping candidates is compared with itself.
    """
    slim = lambda a: F.expr(f"transform({a}, c -> struct(c.kind, c.start, c.end))")
    out = found.withColumn("_base", F.expr("filter(_base, c -> c.passed)")).withColumn("_added", model.added())
    each = "struct(c.start AS start, c.end AS end, c.kind AS kind, double({p}) AS p)"
    line = F.expr(f"array_sort(concat(transform(_base, c -> {each.format(p='2')}), transform(_added, c -> {each.format(p='c.p')})))")
    out = out.withColumn("_line", F.when(F.size("_added") > 0, line))
    whole = "named_struct('p', c.p, 'kind', c.kind, 'start', c.start, 'end', c.end)"
    out = out.withColumn("_runs", F.expr(f"if(size(_added) > 0, {_RUNS.format(all='_line', c=whole, kept=_KEPT)}, cast(array() AS array<array<{_KEPT}>>))"))
    out = out.withColumn("_added", F.expr(f"filter(flatten(transform(_runs, r -> {_CHOSEN.format(c=whole, kept=_KEPT)})), c -> c.p < 2)"))
    return out.withColumn("_base_spans", F.array_sort(slim("_base"))).withColumn("_all_spans", F.array_sort(F.concat(slim("_base"), slim("_added")))).drop("_base", "_loose", "_added", "_line", "_runs")


def _listed(spans_col: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans_col}, c -> concat(array({names})[c.kind], ':', c.start, ':', c.end)), ',')")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and all spans. Null text is empty; an empty table gives no rows; rows may repeat.

    Spans of different kinds may overlap. All counts and places are of whole texts.
    """
    found = cut(candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("_text", "text"))
    return spans(found, fit(found)).select("doc_id", F.col("_base_spans").alias("base"), F.col("_all_spans").alias("all"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets (overlapping spans by the first's), n_chars counted anew where there is one."""
    # docs' own columns travel in one, whatever their names
    found = candidates(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_given")), "_given")
    marked = spans(found, fit(cut(found.select("_base"))))
    marked = marked.withColumn("_spans", F.expr("array_sort(transform(_all_spans, c -> struct(c.start, c.end, c.kind)))"))
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    # spans that begin inside the one before go with it
    ends = "aggregate(_spans, named_struct('end', -1, 'out', cast(array() AS array<struct<start:int,end:int,kind:int>>)), (acc, c) -> if(c.start < acc.end, named_struct('end', greatest(acc.end, c.end), 'out', acc.out), named_struct('end', c.end, 'out', array_append(acc.out, c))), acc -> acc.out)"
    marked = marked.withColumn("_first", F.when(F.size("_spans") > 0, F.expr(ends)))
    reach = "aggregate(filter(_spans, x -> x.start < coalesce(get(_first, k + 1).start, 2147483647) AND x.start >= c.start), 0, (a, x) -> greatest(a, x.end))"
    marked = marked.withColumn("_first", F.when(F.size("_spans") == F.size("_first"), F.col("_first")).otherwise(F.expr(f"transform(_first, (c, k) -> struct(c.start AS start, {reach} AS end, c.kind AS kind))")))
    marked = marked.withColumn("_letters", F.when(F.size("_first") > MANY, F.split("_text", "")))
    cutout = lambda at, n: f"if(_letters IS NULL, substr(_text, {at} + 1, {n}), array_join(slice(_letters, {at} + 1, {n}), ''))"
    before = "if(k = 0, 0, get(_first, k - 1).end)"
    kept = f"transform(_first, (c, k) -> concat({cutout(before, f'c.start - {before}')}, array({names})[c.kind]))"
    rest = cutout("element_at(_first, -1).end", "length(_text)")
    text = F.expr(f"concat(array_join({kept}, ''), {rest})")
    changed = F.size("_spans") > 0
    out = marked.withColumn("_given", F.when(changed, text).otherwise(F.col("_given")))
    new = {text_col: F.col("_given")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_given")).otherwise(F.col("_doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"bigint(size(filter(base, c -> c.kind = {i})))").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("all").alias("spans"))
