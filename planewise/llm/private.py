"""Personal data replaced by keyed surrogates, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import checkpoint

# Alphabets that a character keeps to.
LETTERS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŒ"]
SCRIPTS = ["".join(map(chr, range(a, b))) for a, b in ((0x430, 0x450), (0x410, 0x430), (0x3B1, 0x3CA), (0x391, 0x3A2), (0x5D0, 0x5EB), (0x627, 0x63B), (0x3042, 0x3094), (0x30A2, 0x30F4))]
HEX = ["0123456789abcdef"]
HEX_UPPER = ["0123456789ABCDEF"]
SPOKEN = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщьъ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", *LETTERS[3:], *SCRIPTS[2:]]

# Given names by script and gender, and titles.
GIVEN = [
    "Alice Barbara Carmen Charlotte Claire Daniela Elena Emily Hannah Heidi Isabel Julia Karin Laura Louise Lucia Marie Martina Monica Nathalie Olivia Paula Sabine Sarah Sophie Susan Teresa Ursula Valerie Victoria".split(),
    "Albert Alexander Andreas Antoine Carlos Charles Christian Daniel David Diego Edward Fernando Francois Georg George Hans Henry James Javier Jean Johann John Juan Karl Luis Michael Miguel Oliver Paul Peter Philippe Pierre Robert Stefan Thomas William".split(),
    "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    "Александр Алексей Андрей Дмитрий Иван Михаил Николай Сергей".split(),
]
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|г-н|г-жа"

# How entities are written, in the order in which they are tried.
_SECRET = r"(?:\b(?i:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd)\b\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/.=\-]{8,}+)|(?:\b[0-9a-fA-F]{32,}+\b)"
_EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"
_IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2,3}(?:[ \-][0-9]{1,4})?)(?![0-9])"
_PHONE = r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .\-]?\([0-9]{1,4}\)[ .\-]?[0-9]{2,4}(?:[.\-][0-9]{2,4}){1,3}|(?:[ .\-][0-9]{1,4}){2,5}|[0-9]{6,12})(?![0-9])|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9\-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-])"
_NUMBER = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
_CAPITAL = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_KNOWN = "|".join(n for names in GIVEN for n in names)
# What introduces a name.
CUES = "y name is|ame:|igned:|egards,|incerely,|ontact:|n Name ist|ch heiße|m'appelle|e llamo|nombre es"
_INTRODUCED = rf"(?<=[,:eost][ \n])(?<=(?:{CUES})[ \n])"
_NAME = rf"\b(?=[\p{{Lu}}г])(?:(?:{TITLES})\.? (?:{_CAPITAL} ){{0,2}}{_CAPITAL}|(?:{_KNOWN}) (?:{_CAPITAL} )?{_CAPITAL}|{_INTRODUCED}{_CAPITAL}(?: {_CAPITAL}){{1,2}})"
#: Mailboxes of two words, and the words of a name.
_MAIL_NAME, _NAME_WORD = r"^\p{Ll}{2,}[._\-]\p{Ll}{2,}@", r"^\p{Lu}[\p{L}\-]+$"
ENTITY = "|".join(f"(?:{p})" for p in (_SECRET, _EMAIL, _IBAN, _IP, _CARD, _PHONE, _NUMBER, _NAME))
#: Texts without any of these have no entity; they are far cheaper to look for.
HINTS = ("[0-9@=]", rf"\b(?=[\p{{Lu}}г])(?:{TITLES}|{_KNOWN})\.? \p{{Lu}}", rf"(?:{CUES})[ \n]\p{{Lu}}", r"(?i)(?:key|token|secret|password|passwd)\s{0,3}:|[a-f]{32}")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _number(key: str, what: str, tweak: str) -> str:
    """A keyed number from 0 to 2**32 - 1 that follows from ``tweak``."""
    return f"cast(conv(substr(sha2(concat({_quoted(key + '/' + what + '/')}, {tweak}), 256), 1, 8), 16, 10) as bigint)"


def _pass(x: str, key: str, what: str, alphabets: list[str]) -> str:
    """Each character of ``x`` moved along its alphabet by a keyed number that follows from the characters before it."""
    cases = " ".join(f"when instr({_quoted(a)}, c) > 0 then substr({_quoted(a)}, cast((instr({_quoted(a)}, c) - 1 + h) % {len(a)} + 1 as int), 1)" for a in alphabets)
    step = _let(_number(key, what, "substr(x, 1, i - 1)"), "h", _let("substr(x, i, 1)", "c", f"case {cases} else c end"))
    return _let(x, "x", f"if(x = '', '', aggregate(sequence(1, char_length(x)), '', (acc, i) -> concat(acc, {step})))")


def _cipher(x: str, key: str, what: str, alphabets: list[str] | None = None) -> str:
    """A keyed one-to-one map of strings that keeps their format.

    Two passes, forward and backward, so every character depends on all; characters keep their alphabet and
    everything else its place.  Each pass can be undone, so different strings stay different.
    """
    alphabets = alphabets or LETTERS + SCRIPTS
    forward = _pass(x, key, f"{what}1", alphabets)
    backward = _pass(f"reverse({forward})", key, f"{what}2", alphabets)
    return f"reverse({backward})"


def _octets(x: str, key: str, what: str) -> str:
    """One pass over an array of octets; each keeps its number of digits."""
    h = _number(key, what, "concat_ws('.', slice(o, 1, i - 1))")
    v = "cast(element_at(o, i) as int)"
    moved = f"case when {v} > 99 then 100 + ({v} - 100 + {h}) % 156 when {v} > 9 then 10 + ({v} - 10 + {h}) % 90 else ({v} + {h}) % 10 end"
    return _let(x, "o", f"transform(sequence(1, size(o)), i -> cast({moved} as string))")


def _check_digit(digits: str) -> str:
    """The digit that makes ``digits`` pass the Luhn test."""
    d = "cast(substr(y, char_length(y) - i, 1) as int)"
    total = f"aggregate(sequence(0, char_length(y) - 1), 0L, (acc, i) -> acc + if(i % 2 = 0, ({d} * 2) div 10 + ({d} * 2) % 10, cast({d} as bigint)))"
    return _let(digits, "y", f"(10 - {total} % 10) % 10")


def _card(key: str) -> str:
    """Issuer digit, separators and validity stay: the last digit keeps its distance from the right check digit."""
    body = _let("substr(d, 1, char_length(d) - 1)", "p", _let(f"concat(substr(p, 1, 1), {_cipher('substr(p, 2)', key, 'card')})", "q", f"concat(q, cast(pmod(cast(right(d, 1) as int) - {_check_digit('p')} + {_check_digit('q')}, 10) as string))"))
    digits = _let("regexp_replace(m, '[^0-9]', '')", "d", body)
    place = "char_length(regexp_replace(substr(m, 1, i), '[^0-9]', ''))"
    return _let(digits, "n", f"array_join(transform(sequence(1, char_length(m)), i -> if(substr(m, i, 1) between '0' and '9', substr(n, {place}, 1), substr(m, i, 1))), '')")


def _listed(x: str) -> str:
    return f"array_contains(array({', '.join(_quoted(n) for names in GIVEN for n in names)}), {x})"


def _word(key: str) -> str:
    """Surrogate of a word ``w`` of a name: a known given name becomes another of its list, so of its gender; others stay pronounceable.

    A word that the cipher makes a given name is enciphered again, until it is none: so the other words keep
    to themselves as the given names do, and two words never get one surrogate.
    """
    cases = []
    for k, names in enumerate(GIVEN):
        own = f"array({', '.join(map(_quoted, names))})"
        turn = f"{_number(key, f'given{k}', _quoted(''))} % {len(names) - 1} + 1"
        cases.append(f"when array_contains({own}, w) then element_at({own}, cast((array_position({own}, w) - 1 + {turn}) % {len(names)} + 1 as int))")
    most = sum(map(len, GIVEN))  # given names that can follow each other at most
    on = f"aggregate(slice(sequence(1, {most}), 1, if({_listed('z')}, {most}, 0)), z, (y, j) -> if({_listed('y')}, {_cipher('y', key, 'name', SPOKEN)}, y))"
    return f"case {' '.join(cases)} else {_let(_cipher('w', key, 'name', SPOKEN), 'z', on)} end"


def _title(w: str) -> str:
    return f"regexp_like({w}, '^(?:{TITLES})[.]?$')"


def _name(key: str) -> str:
    """Titles stay, each other word has its surrogate."""
    return f"array_join(transform(split(m, ' '), w -> case when {_title('w')} then w else {_word(key)} end), ' ')"


#: Kinds of entities other than names.
_KINDS = (_SECRET, _EMAIL, _IBAN, _IP, _CARD, _PHONE, _NUMBER)


def _named() -> str:
    """SQL for whether an entity ``m`` is a name: it is of no other kind."""
    return " and ".join(f"not regexp_like(m, {_quoted('^(?:' + p + ')$')})" for p in _KINDS)


def _atoms() -> str:
    """SQL for what is mapped of an entity ``m``: each word of a name that is no title, with ``w`` before it, else all of it, with ``m``."""
    words = f"transform(filter(split(m, ' '), w -> not {_title('w')}), w -> concat('w', w))"
    return f"if({_named()}, {words}, array(concat('m', m)))"


def _of_atom(key: str) -> str:
    """SQL for the surrogate of an atom ``a``, itself an atom."""
    return f"if(left(a, 1) = 'w', concat('w', {_let('substr(a, 2)', 'w', _word(key))}), concat('m', {_let('substr(a, 2)', 'm', _surrogate(key))}))"


def _surrogate(key: str) -> str:
    """SQL for the surrogate of an entity ``m``, by its kind."""
    parts = _quoted(r"^(.*?[=:]\s*[\"']?)?([A-Za-z0-9_+/.=\-]+)$")
    before, value = f"regexp_extract(m, {parts}, 1)", f"regexp_extract(m, {parts}, 2)"
    kinds = f"when regexp_like(v, '^[0-9a-f]+$') then {_cipher('v', key, 'hex', HEX)} when regexp_like(v, '^[0-9A-F]+$') then {_cipher('v', key, 'hex', HEX_UPPER)}"
    secret = _let(value, "v", f"concat({before}, case {kinds} else {_cipher('v', key, 'secret')} end)")
    local, host = "substring_index(m, '@', 1)", "split(substring_index(m, '@', -1), '[.]')"
    labels = _let(host, "labels", f"transform(labels, (e, k) -> if(k = size(labels) - 1, e, {_cipher('e', key, 'domain')}))")
    email = f"concat({_cipher(local, key, 'email')}, '@', array_join({labels}, '.'))"
    country = "regexp_extract(m, '^([+][0-9]{1,3})(?=[^0-9])', 1)"
    phone = f"concat({country}, {_cipher(f'substr(m, char_length({country}) + 1)', key, 'phone')})"
    forward = _octets("split(m, '[.]')", key, "ip1")
    backward = _octets(f"reverse({forward})", key, "ip2")
    ip = f"array_join(reverse({backward}), '.')"
    iban = f"concat(substr(m, 1, 2), {_cipher('substr(m, 3)', key, 'iban')})"

    def full(pattern: str) -> str:
        return f"regexp_like(m, {_quoted('^(?:' + pattern + ')$')})"

    return (
        f"case when {full(_SECRET)} then {secret} when {full(_EMAIL)} then {email} when {full(_IBAN)} then {iban} when {full(_IP)} then {ip} "
        f"when {full(_CARD)} then {_card(key)} when {full(_PHONE)} then {phone} when {full(_NUMBER)} then {_cipher('m', key, 'number')} else {_name(key)} end"
    )


def _longer(key: str, k: int) -> str:
    """SQL for a surrogate of an atom ``a`` beyond its format: ``k`` further parts of a name or mailbox, else a number behind it.

    An address gets four octets of three digits in the first ten rounds.  Not one-to-one by itself.
    """
    name = f"concat('w', {_word(f'{key}/longer{k}')}, repeat(lower(regexp_extract({_word(f'{key}/part{k}')}, '[^ -]+$', 0)), {k}))"
    email = f"concat(repeat(substring_index({_surrogate(f'{key}/part{k}')}, '@', 1), {k}), b)"
    octets = ", ".join(f"cast(100 + {_number(key, f'octet{k}.{i}', 'm')} % 156 as string)" for i in range(4))
    ip = f"concat_ws('.', {octets})"
    number = f"concat(b, '-', lpad(cast({_number(key, f'behind{k}', 'm')} as string), 10, '0'))"
    kinds = [(_SECRET, number), (_EMAIL, email), (_IBAN, number), (_IP, ip if k <= 10 else number), (_CARD, number), (_PHONE, number), (_NUMBER, number)]
    cases = " ".join(f"when regexp_like(m, {_quoted('^(?:' + pattern + ')$')}) then {body}" for pattern, body in kinds)
    other = _let("substr(a, 2)", "m", _let(_surrogate(f"{key}/longer{k}"), "b", f"concat('m', case {cases} else b end)"))
    return f"if(left(a, 1) = 'w', {_let('substr(a, 2)', 'w', name)}, {other})"


def _close(found: str) -> str:
    """SQL for the words by which a document may speak of its people again: those of the names and mailboxes ``found`` in it."""
    names = f"filter({found}, m -> regexp_like(m, {_quoted('^(?:' + _NAME.replace(_INTRODUCED, '') + ')$')}))"
    words = f"filter(flatten(transform({names}, m -> split(m, ' '))), w -> regexp_like(w, {_quoted(_NAME_WORD)}) and not regexp_like(w, '^(?:{TITLES})$'))"
    mails = f"filter({found}, m -> regexp_like(m, {_quoted(_MAIL_NAME)}))"
    return f"array_distinct(concat({words}, flatten(transform({mails}, m -> transform(split(substring_index(m, '@', 1), '[._-]'), w -> initcap(w))))))"


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", max_rounds: int = 20) -> DataFrame:
    """Replace personal data by surrogates: ``doc_id``, ``text`` and ``n_entities`` of every row.

    Found are e-mail, IPv4 and bank account addresses, payment cards, phone and national numbers, secrets, and names
    after a title, a known given name or words that introduce one; then, within the same text, every mention of a word of
    these names or of a mailbox of two words, so that a person named in full is not left in clear by surname later on.
    Names without any of these signs are not found.  ``key`` is a secret of the caller's.  A surrogate follows from the key and the entity alone, so
    mentions of one entity stay mentions of one, in all documents.  What is mapped is each word of a name but its title, and every other
    entity as a whole; the map is one-to-one, so different entities stay different, and a name's parts follow it wherever they stand.  It keeps the format: separators, lengths, scripts and case, check digits, the number
    of digits of an octet, country codes, top-level domains, titles, and the gender of known given names.

    A surrogate that is itself an entity, or a word of a name, of the corpus would expose that one.  Such cases, and any two that share a
    surrogate, are looked for over all distinct ones of all texts; they get the map of another key, then of a third and so on, until the result is neither
    an entity nor the surrogate of another one.  After ``max_rounds`` of them, as where the corpus fills all
    values of a short format, the format gives way: the surrogate grows, by one more part each round.  A text that is null stays null; texts without entities are unchanged; repeated
    rows and null ids keep a row each; an empty table gives an empty result; further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    hinted = F.coalesce(reduce(or_, (F.col("body").rlike(h) for h in HINTS)), F.lit(False))
    # in texts that name people, the words of the names are entities as well; each text is searched once or twice
    word = "concat('(?:', array_join(c, '|'), ')')"
    wider = f"concat({_quoted(ENTITY + '|' + chr(92) + 'b')}, {word}, '(?: ', {word}, ')*', {_quoted(chr(92) + 'b')})"
    again = f"struct(if(size(c) > 0, regexp_extract_all(body, {wider}, 0), f) as found, if(size(c) > 0, {wider}, {_quoted(ENTITY)}) as pattern)"
    found = F.expr(_let(f"regexp_extract_all(body, {_quoted(ENTITY)}, 0)", "f", _let(_close("f"), "c", again)))
    none = F.struct(F.array().cast("array<string>").alias("found"), F.lit(ENTITY).alias("pattern"))
    rows = rows.withColumn("x", F.when(hinted, found).otherwise(none)).select("doc_id", "body", "x.found", "x.pattern")
    # what is mapped are words of names and other entities, so that all mentions of a word move together
    # an outer explode adds no filter that would search the texts once more
    entities = rows.select(F.explode_outer("found").alias("m")).where("m is not null").distinct()
    atoms = entities.select(F.explode(F.expr(_atoms())).alias("a")).distinct()
    atoms = checkpoint(atoms.selectExpr("a", f"{_of_atom(key)} as s"))
    taken = atoms.select(F.col("a").alias("s")).unionByName(atoms.select("s"))
    walked = None
    # those whose surrogate is one of them, and of those with one surrogate all but the least
    least = atoms.groupBy("s").agg(F.min("a").alias("least")).join(atoms.select(F.col("a").alias("s"), F.lit(True).alias("met")), "s", "left")
    open_ = checkpoint(atoms.join(least, "s").where("met or a <> least").select("a"))
    turn = 0
    while not open_.isEmpty():
        turn += 1
        again = _of_atom(f"{key}/again{turn}") if turn <= max_rounds else _longer(key, turn - max_rounds)
        # of those that get the same one, the least keeps it
        free = open_.selectExpr("a", f"{again} as s").groupBy("s").agg(F.min("a").alias("a")).join(taken, "s", "left_anti")
        done = checkpoint(free.select("a", "s"))
        walked = done if walked is None else walked.unionByName(done)
        taken = taken.unionByName(done.select("s"))
        open_ = checkpoint(open_.join(done, "a", "left_anti"))
    given = f"transform(found, m -> {_surrogate(key)})"
    if walked is not None:
        # rows that hold such an atom get the list of exceptions that they need
        own = rows.where("size(found) > 0").select(F.xxhash64("body").alias("h"), F.explode(F.array_distinct(F.expr(f"flatten(transform(found, m -> {_atoms()}))"))).alias("a"))
        extra = own.distinct().join(walked, "a").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("a", "s"))).alias("extra"))
        rows = rows.withColumn("h", F.xxhash64("body")).join(extra, "h", "left")
        words = f"array_join(transform(split(m, ' '), w -> case when {_title('w')} then w else coalesce(substr(extra[concat('w', w)], 2), {_word(key)}) end), ' ')"
        changed = f"transform(found, m -> if({_named()}, {words}, coalesce(substr(extra[concat('m', m)], 2), {_surrogate(key)})))"
        given = f"if(extra is null, {given}, {changed})"
    between = F.expr("split(body, pattern, -1)")
    text = F.array_join(F.zip_with(between, F.concat(F.expr(given), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return rows.select("doc_id", F.when(F.size("found") > 0, text).otherwise(F.col("body")).alias("text"), F.size("found").cast("long").alias("n_entities"))
