"""Personal data replaced by keyed surrogates, wholly in DataFrame and SQL functions.

Found are e-mail addresses, phone numbers, IPv4 addresses, payment cards (13 to 19 digits that pass the
Luhn check), IBANs, US social security numbers, secrets (hexadecimal runs of 32 or more, well-known key
prefixes, quoted values of token, secret, password and key) and names behind a title.  A surrogate is
drawn from a keyed SHA-512 stream of the entity's canonical form, so it is the same everywhere (coreference)
and has the same type: letters stay letters and digits digits, with their case and separators; addresses
keep valid octets, cards their check digit, e-mails their top-level domain and one surrogate per domain,
phones their country code; names match the title's gender and the script (Latin or Cyrillic).
A name's last word is an entity of its own (kind ``surname``, per script), so full and short forms agree.

Collision check: over the distinct entities of all documents, a surrogate that another entity has, or
that is itself an entity of the corpus, is drawn again, until all are distinct as they are written: last
words among all last words, first names among those of one gender and last word.  Entities are made
distinct by partial aggregation, so a hot one is one row per task.  Only entities drawn again are joined
back, to the documents that hold them; all other surrogates are computed in place, between two splits of
the text, so texts cross no exchange while that list is small enough for the planner to broadcast.

Defined results: null and empty texts come back as empty texts without entities; rows that repeat are replaced
alike, a null doc_id too; matches never overlap, the leftmost wins, then the order of ``PATTERNS``; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

KEY = "surrogate-key"
#: From which attempt on a surrogate gets longer, and from which on it may equal an entity of the corpus.
GROW, RELAX = 8, 16
#: Titles with a gender, Latin then Cyrillic.
HE, SHE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Signor|Don", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Signora|Doña"
HE_C, SHE_C = "Г-н|Господин", "Г-жа|Госпожа"
FIRST = {"m": "James Peter Daniel Lucas Thomas Martin Felix Paul David Simon Oscar Victor Hugo Leon Adam Bruno",
         "f": "Anna Clara Marie Julia Laura Sofia Emma Nina Helen Rosa Alice Eva Lena Iris Carla Paula",
         "mc": "Иван Пётр Антон Павел Артём Денис Егор Роман", "fc": "Анна Мария Ольга Елена Ирина Дарья Юлия Вера"}
SYLLABLE = "ba be bo da de di fa fe ga go ha ho ka ko la le li lo ma me mi mo na no pa ra ri ro sa so ta to"
SYLLABLE_C = "ба бо ва ви го да де зо ка ко ла ле ли ма ми мо на но па по ра ре ро са со та те то фо ша ши ха"

OUTSIDE = r"\s\"<>()\[\],;:|'"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: An address has up to 64 characters before its @ and labels of up to 63, at most 127 of them.
#: Each alternative first asks for what is cheap and rare, so that ordinary text is passed over quickly.
PATTERNS = {
    "email": rf"(?<![^{OUTSIDE}])[^@{OUTSIDE}]{{1,64}}+@(?:[\p{{L}}\p{{N}}-]{{1,63}}+\.){{1,127}}\p{{L}}{{2,}}",
    "name": rf"(?=[MHFSDГ])(?<!\p{{L}})(?:{HE}|{SHE}|{HE_C}|{SHE_C})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
    "ip": rf"(?=\d)(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[+])(?<!\d)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?=[(])(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
             r"|(?=\d)(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    "card": r"(?=\d)(?<![\dA-Za-z+])(?:\d{13,19}|(?:\d{4} ){3}\d{1,7}|(?:\d{4}-){3}\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\dA-Za-z])",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?=[0-9A-Fa-f])(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
              r"|(?=[Agsx])(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,})"
              r"|(?<=[\"'])(?<=(?i:token|secret|password|passwd|api_key|apikey) ?[=:] ?[\"'])[^\s\"']{8,}(?=[\"'])",
}
SOME = "[0-9@\"']|[A-Fa-f]{32}|xox"
ANY = "|".join(PATTERNS.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(d: str) -> str:
    """SQL: the Luhn sum of a digit string, mod 10."""
    x = f"CAST(substr({d}, i, 1) AS INT)"
    return (f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN (length({d}) - i) % 2 = 0 THEN {x} "
            f"WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END) % 10")


def _kind(m: str) -> str:
    """SQL: type of a match, null where a check fails."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    whole = lambda name: f"{m} RLIKE {_quoted('^(?:' + PATTERNS[name] + ')$')}"
    card = f"CASE WHEN {_luhn(digits)} = 0 AND length({digits}) BETWEEN 13 AND 19 THEN 'card' END"
    return (f"CASE WHEN instr({m}, '@') > 0 AND {whole('email')} THEN 'email' WHEN {whole('name')} THEN 'name' WHEN {whole('ip')} THEN 'ip' "
            f"WHEN {whole('ssn')} THEN 'ssn' WHEN {whole('phone')} THEN 'phone' WHEN {whole('card')} THEN {card} "
            f"WHEN {whole('iban')} THEN 'iban' ELSE 'secret' END")


def _code(m: str) -> str:
    """SQL: number of digits of a phone's country code."""
    return f"greatest(length(regexp_extract({m}, '^[+][0-9]{{1,3}}(?=[ .(-])', 0)) - 1, 0)"


def _canon(m: str, kind: str) -> str:
    """SQL: canonical form; names lose their title's spelling but keep its gender and script."""
    male = _quoted(f"^(?:{HE}|{HE_C})\\.? ")
    gender = f"CASE WHEN {m} RLIKE {male} THEN 'm' ELSE 'f' END || CASE WHEN {m} RLIKE '[\\\\u0400-\\\\u04FF]' THEN 'c' ELSE '' END"
    return (f"CASE {kind} WHEN 'email' THEN lower({m}) WHEN 'ip' THEN {m} WHEN 'secret' THEN {m} "
            f"WHEN 'phone' THEN concat({_code(m)}, ':', regexp_replace({m}, '[^0-9]', '')) WHEN 'name' THEN {gender} || ':' || lower(regexp_replace({m}, '^[^ ]+ ', '')) ELSE lower(regexp_replace({m}, '[^A-Za-z0-9]', '')) END")


def _stream(text: str, attempt: str) -> str:
    """SQL: 128 keyed hexadecimal digits."""
    return f"sha2(concat_ws('|', __key, {text}, CAST({attempt} AS STRING)), 512)"


def _byte(h: str, i: str) -> str:
    return f"CAST(conv(substr({h}, 1 + (2 * ({i} - 1)) % 126, 2), 16, 10) AS INT)"


def _drawn(text: str, h: str, letters: str = "'abcdefghijklmnopqrstuvwxyz'") -> str:
    """SQL: letters for letters and digits for digits, the rest as it is."""
    c, v = "c", _byte("h", "(j + 1)")  # by code point, in time that grows with the length
    return (f"array_join(transform(array({h}), h -> array_join(transform(regexp_extract_all({text}, '(?s).', 0), (c, j) -> CASE WHEN {c} RLIKE '[0-9]' THEN CAST({v} % 10 AS STRING) "
            f"WHEN {c} RLIKE '[\\\\u0400-\\\\u04FF]' THEN substr('абвгдежзиклмнопрстуфхцчшэюя', 1 + {v} % 27, 1) "
            f"WHEN {c} RLIKE '\\\\p{{Lu}}' THEN upper(substr({letters}, 1 + {v} % length({letters}), 1)) "
            f"WHEN {c} RLIKE '\\\\p{{L}}' THEN substr({letters}, 1 + {v} % length({letters}), 1) ELSE {c} END), '')), '')")


def _pick(words: str, value: str) -> str:
    return f"element_at(split({_quoted(words)}, ' '), 1 + CAST({value} % {len(words.split())} AS INT))"


def _last(canon: str) -> str:
    """SQL: canonical form of a name's last word: script and word."""
    return f"(CASE WHEN {canon} LIKE '_c:%' THEN 'c:' ELSE 'l:' END || substring_index(substring_index({canon}, ':', -1), ' ', -1))"


def _surname(last: str, attempt: str) -> str:
    """SQL: surrogate of a canonical last word, a syllable longer with every attempt."""
    pick = f"CASE WHEN {last} LIKE 'c:%' THEN {_pick(SYLLABLE_C, _byte('h', 'i'))} ELSE {_pick(SYLLABLE, _byte('h', 'i'))} END"
    return f"array_join(transform(array({_stream(f"concat('surname', {last})", attempt)}), h -> initcap(array_join(transform(sequence(1, 3 + {attempt}), i -> {pick}), ''))), '')"


def _first(canon: str, attempt: str) -> str:
    """SQL: surrogate first name of a canonical name; every attempt joins one name more."""
    pick = "CASE " + " ".join(f"WHEN {canon} LIKE '{g}:%' THEN {_pick(FIRST[g], _byte('h', 'i'))}" for g in ("mc", "fc", "m", "f")) + " END"
    return f"array_join(transform(array({_stream(f"concat('name', {canon})", attempt)}), h -> initcap(array_join(transform(sequence(1, 1 + {attempt}), i -> {pick}), ''))), '')"


def _surrogate(kind: str, canon: str, attempt: str, last_attempt: str) -> str:
    """SQL: the canonical surrogate of a canonical entity; of a name's last word the attempt is ``last_attempt``.  One draw serves all types: what of the entity is
    drawn depends on its type, and so does what is put around it."""
    h = _stream(f"concat({kind}, {canon})", attempt)
    host = f"regexp_replace(substring_index({canon}, '@', -1), '[.][^.]*$', '')"
    at = f"(instr({canon}, ':') + CAST(substring_index({canon}, ':', 1) AS INT))"
    part = (f"CASE {kind} WHEN 'email' THEN substring_index({canon}, '@', 1) WHEN 'card' THEN substr({canon}, 1, length({canon}) - 1) "
            f"WHEN 'phone' THEN substr({canon}, {at} + 1) WHEN 'iban' THEN substr({canon}, 3) WHEN 'name' THEN '' WHEN 'ip' THEN '' ELSE {canon} END")
    letters = f"CASE WHEN {kind} = 'secret' AND {canon} RLIKE '^[0-9A-Fa-f]+$' THEN 'abcdef' ELSE 'abcdefghijklmnopqrstuvwxyz' END"
    drawn = f"array_join(transform(array(named_struct('t', concat({part}, CASE WHEN {kind} IN ('name', 'ip') THEN '' ELSE repeat('0', greatest({attempt} - {GROW}, 0)) END), 'l', {letters})), p -> {_drawn('p.t', h, 'p.l')}), '')"
    ip = "array_join(transform(array(" + h + "), h -> array_join(transform(sequence(1, 4), i -> CAST(CASE WHEN i = 1 THEN 1 + " + _byte("h", "i") + " % 223 ELSE " + _byte("h", "i") + " END AS STRING)), '.')), '')"
    name = f"{_first(canon, attempt)} || ' ' || {_surname(_last(canon), last_attempt)}"
    around = (f"CASE {kind} WHEN 'email' THEN d || '@' || {_drawn(host, _stream(host, '0'))} || '.' || substring_index({canon}, '.', -1) "
              f"WHEN 'card' THEN d || CAST((10 - {_luhn('(d || 0)')}) % 10 AS STRING) WHEN 'phone' THEN substr({canon}, 1, {at}) || d "
              f"WHEN 'iban' THEN substr({canon}, 1, 2) || d WHEN 'ip' THEN {ip} WHEN 'name' THEN {name} ELSE d END")
    return f"array_join(transform(array({drawn}), d -> {around}), '')"


def _render(m: str, kind: str, s: str) -> str:
    """SQL: the canonical surrogate in the match's case and separators."""
    k = f"length(regexp_replace(substr({m}, 1, i), '[^A-Za-z0-9]', ''))"
    c, d = f"substr({m}, i, 1)", f"substr(substring_index({s}, ':', -1), {k}, 1)"
    spread = (f"array_join(transform(sequence(1, length({m})), i -> CASE WHEN {c} RLIKE '[A-Z]' THEN upper({d}) WHEN {c} RLIKE '[a-z0-9]' THEN {d} ELSE {c} END), '') || substr(substring_index({s}, ':', -1), 1 + length(regexp_replace({m}, '[^A-Za-z0-9]', '')))")
    email = f"array_join(transform(sequence(1, length({s})), i -> CASE WHEN {c} RLIKE '\\\\p{{Lu}}' THEN upper(substr({s}, i, 1)) ELSE substr({s}, i, 1) END), '')"
    title = f"regexp_extract({m}, '^[^ ]+ ', 0)"
    one = f"CASE WHEN regexp_replace({m}, '^[^ ]+ ', '') LIKE '% %' THEN {s} ELSE substring_index({s}, ' ', -1) END"
    return (f"CASE {kind} WHEN 'email' THEN {email} WHEN 'ip' THEN {s} WHEN 'secret' THEN {s} WHEN 'name' THEN {title} || {one} ELSE {spread} END")


def found_entities(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with __found: an array of (match, kind, canon), kind null for rejects."""
    # every pattern needs a digit, an @, a quotation mark or a title: most texts are done after two quick looks
    some = f"text RLIKE {_quoted(SOME)} OR text RLIKE {_quoted(PATTERNS['name'])}"
    hits = F.expr(f"CASE WHEN {some} THEN regexp_extract_all(text, {_quoted(ANY)}, 0) ELSE CAST(array() AS array<string>) END")
    kinds = f"transform(__hits, m -> named_struct('m', m, 'kind', {_kind('m')}))"
    canon = f"transform(__kinds, x -> named_struct('m', x.m, 'kind', x.kind, 'canon', {_canon('x.m', 'x.kind')}))"
    return docs.withColumn("__hits", hits).withColumn("__kinds", F.expr(kinds)).withColumn("__found", F.expr(canon)).drop("__hits", "__kinds")


def with_surnames(entities: DataFrame) -> DataFrame:
    """``entities`` (kind, canon, ...) and, for every name, its last word as an entity of kind ``surname``."""
    own = f"CASE WHEN kind = 'name' THEN array(named_struct('kind', kind, 'canon', canon), named_struct('kind', 'surname', 'canon', {_last('canon')})) ELSE array(named_struct('kind', kind, 'canon', canon)) END"
    rest = [c for c in entities.columns if c not in ("kind", "canon")]
    return entities.withColumn("__own", F.explode(F.expr(own))).select(*rest, "__own.kind", "__own.canon")


def written(kind: str, canon: str, attempt: str) -> str:
    """SQL: what must be distinct, in the form of ``canon`` where it may equal an entity.  Last words are one to one and
    none is an entity, so a first name need only differ from the others before its last word."""
    return (f"CASE {kind} WHEN 'surname' THEN substr({canon}, 1, 2) || lower({_surname(canon, attempt)}) "
            f"WHEN 'name' THEN concat(substring_index({canon}, ':', 1), ':', {_first(canon, attempt)}, '|', {_last(canon)}) ELSE {_surrogate(kind, canon, attempt, '0')} END")


def redrawn(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, attempt) of the distinct ``entities``, and last words of names, whose surrogate collides at attempt 0.

    It ends: from attempt ``GROW`` on a surrogate is a character longer each time, so its space outgrows any number of entities; an IPv4
    address can't grow, and may be one of the corpus from attempt ``RELAX`` on, where most addresses are taken."""
    known = stage(with_surnames(entities.filter("kind IS NOT NULL")).filter("kind <> 'name' OR canon LIKE '% %'").distinct(), "entities")
    now = known.withColumn("attempt", F.lit(0))
    while True:
        drawn = stage(now.withColumn("__key", F.lit(key)).withColumn("s", F.expr(written("kind", "canon", "attempt"))).drop("__key"), "drawn")
        shared = drawn.groupBy("kind", "s").agg(F.min_by("canon", F.struct(F.col("attempt"), "canon")).alias("owner"), F.count("*").alias("n"))
        taken = known.select("kind", F.col("canon").alias("s"), F.lit(True).alias("real"))
        bad = shared.join(taken, ["kind", "s"], "left").filter("n > 1 OR real").select("kind", "s", "owner", F.coalesce("real", F.lit(False)).alias("real"))
        again = drawn.join(bad, ["kind", "s"], "left").withColumn("again", F.coalesce(F.expr(f"(real AND attempt < {RELAX}) OR canon <> owner"), F.lit(False)))
        again = stage(again.select("kind", "canon", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "again"), "attempts")
        if again.filter("again").isEmpty():
            return stage(again.filter("attempt > 0").select("kind", "canon", "attempt"), "redrawn")
        now = again.drop("again")


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The rows of ``docs`` with surrogates in ``text``, and n_entities and entities (type=count); other columns stay.  Give a
    ``key`` of your own and keep it secret: who has it can test guesses."""
    base = docs.withColumn("text", F.coalesce("text", F.lit("")))
    found = found_entities(base.select("text")).select(F.explode("__found").alias("x")).select("x.kind", "x.canon")
    again = redrawn(found, key)
    rows = found_entities(base)
    if again.isEmpty():
        rows = rows.withColumn("__again", F.expr("CAST(map() AS map<string,int>)"))
    else:
        held = found_entities(base.select(F.xxhash64("text").alias("__tid"), "text")).select("__tid", F.explode("__found").alias("x")).select("__tid", "x.kind", "x.canon").filter("kind IS NOT NULL")
        held = with_surnames(held).distinct()
        per = stage(held.join(again, ["kind", "canon"]).groupBy("__tid").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "canon"), "attempt"))).alias("__again")), "held")
        rows = rows.join(per, F.xxhash64("text") == F.col("__tid"), "left").drop("__tid").withColumn("__again", F.coalesce("__again", F.expr("CAST(map() AS map<string,int>)")))
    attempt = lambda kind, canon: f"coalesce(try_element_at(__again, concat_ws(chr(58), {kind}, {canon})), 0)"
    drawn = f"transform(__found, x -> CASE WHEN x.kind IS NULL THEN x.m ELSE array_join(transform(array({_surrogate('x.kind', 'x.canon', attempt('x.kind', 'x.canon'), attempt("'surname'", _last('x.canon')))}), s -> {_render('x.m', 'x.kind', 's')}), '') END)"
    pieces = f"zip_with(split(text, {_quoted(ANY)}, -1), __surrogates, (p, s) -> concat(p, coalesce(s, '')))"
    out = rows.withColumn("__key", F.lit(key)).withColumn("__surrogates", F.expr(drawn)).withColumn("__new", F.expr(f"CASE WHEN size(__found) = 0 THEN text ELSE array_join({pieces}, '') END"))
    kinds = "filter(transform(__found, x -> x.kind), k -> k IS NOT NULL)"
    counts = f"transform(array_sort(array_distinct({kinds})), k -> concat(k, '=', CAST(size(filter({kinds}, y -> y = k)) AS STRING)))"
    return (out.withColumn("n_entities", F.expr(f"CAST(size({kinds}) AS BIGINT)")).withColumn("entities", F.expr(f"array_join({counts}, ',')"))
            .withColumn("text", F.col("__new")).drop("__new", "__found", "__again", "__surrogates", "__key"))
