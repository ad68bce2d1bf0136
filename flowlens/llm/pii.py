"""Format-preserving pseudonyms for personal data, in SQL functions only.

Values are found by one pattern, validated (Luhn, calendar, octets, area
numbers, mod 97), permuted by a keyed Feistel network over exactly the set of
valid values of their format, and put back in place.  The permutation depends
on key, kind and value only, so equal values stay equal across documents and
different values stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 10
KINDS = ("email", "phone", "ip", "ssn", "date", "iban", "secret", "card")

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Possessive, bounded (a secret: a single run) and anchored by look-behinds, so that no text makes the matcher walk back and forth.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<![\d)])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}([.\-])\d{3}\1\d{4}(?![\d\-])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])",
    "date": r"(?<![\d\-])(?:19|20)\d\d-[01]\d-[0-3]\d(?![\d\-])|(?<![\d/])[0-3]\d/[01]\d/(?:19|20)\d\d(?![\d/])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?i:password|passwd|token|secret|api_?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9]{16,}+|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "card": r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?!\d)",
}
# Candidates that may run on into what follows: the first group alone is taken from the text, so that the search goes on inside one
# that is not valid, and besides the whole the prefixes that end at a separator and have one of these forms are tested.
HEADS = {"iban": r"[A-Z]{2}\d{2}[A-Z0-9]*+", "card": r"\d++"}
PARTS = {"iban": r"^(?: ?[A-Z0-9]){15,}$", "card": r"^(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ \-])\d{6}\2\d{4,5})$"}
# What any match has: every pattern needs an ASCII digit or "@", but for the secrets, which may be letters only.
MAY = r"[0-9@]|AKIA|(?i:passw|token|secret|api_?key)"


def _q(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def feistel_pair(left: str, right: str, m_left: int, m_right: int, key: str, tag: str) -> str:
    """SQL struct (l, r): a keyed permutation of [0, m_left) x [0, m_right); each round adds a hash of one half to the other."""
    h = "cast(conv(substring(sha2(concat_ws('|', {k}, '{t}', i, {v}), 256), 1, 13), 16, 10) as bigint)"
    on = lambda v: h.format(k=_q(key), t=tag, v=v)
    return (f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (x, i) -> "
            f"if(i % 2 = 0, named_struct('l', pmod(x.l + {on('x.r')}, {m_left}L), 'r', x.r), named_struct('l', x.l, 'r', pmod(x.r + {on('x.l')}, {m_right}L))))")


def feistel_text(value: str, key: str, tag: str, letters: int = 26) -> str:
    """SQL string: a keyed permutation of the strings with the same class at every place.

    Digits stay digits, small letters small, capitals capitals (``letters`` of
    them: 26, or 6 to stay hexadecimal); other characters stay as they are.
    Each round shifts every place of one half by key stream from the other.
    """
    step = "cast(conv(substring(h, 4 * (j - if(r % 2 = 0, 0, shiftright(size(y), 1))) % 124 + 1, 4), 16, 10) as int)"
    shifted = (f"CASE WHEN c BETWEEN '0' AND '9' THEN char(48 + (ascii(c) - 48 + {step}) % 10) "
               f"WHEN c BETWEEN 'a' AND 'z' THEN char(97 + (ascii(c) - 97 + {step}) % {letters}) "
               f"WHEN c BETWEEN 'A' AND 'Z' THEN char(65 + (ascii(c) - 65 + {step}) % {letters}) ELSE c END")
    other = "if(r % 2 = 0, substring(x, shiftright(length(x), 1) + 1, length(x)), substring(x, 1, shiftright(length(x), 1)))"
    stream = f"sha2(concat_ws('|', {_q(key)}, '{tag}', r, length(x), {other}), 512)"
    # an array of the characters, j from 0 on, so that long values take linear time
    body = f"array_join(transform(y, (c, j) -> if((j < shiftright(size(y), 1)) = (r % 2 = 0), {shifted}, c)), '')"
    return f"if(length({value}) = 0, '', aggregate(sequence(0, {ROUNDS - 1}), {value}, (x, r) -> {_let(stream, 'h', _let('split(x, ' + _q('') + ')', 'y', body))}))"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(layout: str, digits: str) -> str:
    """SQL: the digits of ``layout`` replaced in turn by those of ``digits``."""
    at = f"length(regexp_replace(substring({layout}, 1, p), '[^0-9]', ''))"
    return (f"array_join(transform(sequence(1, length({layout})), p -> if(substring({layout}, p, 1) BETWEEN '0' AND '9', "
            f"substring({digits}, {at}, 1), substring({layout}, p, 1))), '')")


def _luhn_sum(digits: str, first_doubled: str) -> str:
    """Luhn sum from the right; ``first_doubled``: 1 if the last digit is doubled, 0 if not."""
    v = f"cast(substring({digits}, length({digits}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, k) -> a + if((k + {first_doubled}) % 2 = 1, {v} * 2 - if({v} > 4, 9, 0), {v}))"


def _mod97(s: str) -> str:
    """Remainder of an IBAN's rearranged number by 97."""
    c = f"substring({s}, k, 1)"
    return (f"aggregate(sequence(1, length({s})), 0, (a, k) -> if({c} BETWEEN '0' AND '9', (a * 10 + ascii({c}) - 48) % 97, "
            f"(a * 100 + ascii({c}) - 55) % 97))")


def replacements(key: str) -> dict[str, str]:
    """SQL for the pseudonym of a match ``m`` by kind; null where it is not valid."""
    email = _let("split(m, '@')", "e", f"concat({feistel_text('e[0]', key, 'email')}, '@', e[1])")

    def national(m):  # a phone number's last ten digits
        d = _digits(m)
        return _let(d, "d", _let(f"concat(substring(d, 1, length(d) - 10), {feistel_text('right(d, 10)', key, 'phone')})", "n", _refill(m, "n")))

    ip = _let("transform(split(m, '[.]'), o -> cast(o as int))", "o", _let(
        feistel_pair("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", 65536, 65536, key, "ip"), "n",
        "concat_ws('.', n.l div 256, n.l % 256, n.r div 256, n.r % 256)"))
    area = "cast(substring(m, 1, 3) as int)"
    ssn = _let(feistel_pair(f"{area} - 1 - if({area} > 666, 1, 0)", "(cast(substring(m, 5, 2) as int) - 1) * 9999 + cast(right(m, 4) as int) - 1",
                            898, 99 * 9999, key, "ssn"), "n",
               "concat_ws('-', lpad(n.l + 1 + if(n.l >= 665, 1, 0), 3, '0'), lpad(n.r div 9999 + 1, 2, '0'), lpad(n.r % 9999 + 1, 4, '0'))")
    # the 73,049 days from 1900-01-01 to 2099-12-31, as 17 x 4,297
    iso = "if(m LIKE '%/%', concat_ws('-', right(m, 4), substring(m, 4, 2), left(m, 2)), m)"
    date = _let(f"datediff(try_cast({iso} as date), date'1900-01-01')", "t", "if(t BETWEEN 0 AND 73048, " + _let(
        feistel_pair("t div 4297", "t % 4297", 17, 4297, key, "date"), "n", _let(
            "date_add(date'1900-01-01', cast(n.l * 4297 + n.r as int))", "y", "date_format(y, if(m LIKE '%/%', 'dd/MM/yyyy', 'yyyy-MM-dd'))")) + ", NULL)")
    bban = _let("replace(m, ' ', '')", "s", f"if({_mod97('concat(substring(s, 5, length(s)), left(s, 4))')} = 1, " + _let(
        feistel_text("substring(s, 5, length(s))", key, "iban"), "b", _let(
            f"concat(left(s, 2), lpad(98 - {_mod97('concat(b, left(s, 2), ' + chr(39) + '00' + chr(39) + ')')}, 2, '0'), b)", "n",
            "array_join(transform(sequence(1, length(m)), p -> if(substring(m, p, 1) = ' ', ' ', "
            "substring(n, length(replace(substring(m, 1, p), ' ', '')), 1))), '')")) + ", NULL)")
    value = r"regexp_extract(m, '[A-Za-z0-9]+$', 0)"
    secret = _let(f"if(m LIKE 'AKIA%', substring(m, 5, 16), {value})", "v",
                  "concat(left(m, length(m) - length(v)), if(v RLIKE '^([0-9a-f]+|[0-9A-F]+)$', "
                  f"{feistel_text('v', key, 'hex', 6)}, {feistel_text('v', key, 'secret')}))")
    card = _let(_digits("m"), "d", f"if({_luhn_sum('d', '0')} % 10 = 0, " + _let(
        feistel_text("left(d, length(d) - 1)", key, "card"), "b", _let(
            f"concat(b, (10 - {_luhn_sum('b', '1')} % 10) % 10)", "n", _refill("m", "n"))) + ", NULL)")
    return {"email": email, "phone": national("m"), "ip": ip, "ssn": ssn, "date": date, "iban": bban, "secret": secret, "card": card}


def _numbered(kind: str) -> str:
    """The kind's pattern with its own back reference renamed, so that all fit in one pattern; candidates with a head as a group ahead of it."""
    own = PATTERNS[kind].replace(r"([.\-])", r"(?<sep>[.\-])").replace(r"\1", r"\k<sep>")
    return f"(?=({own})){HEADS[kind]}" if kind in HEADS else own


def settled(key: str, text: str) -> Column:
    """For the column ``text`` with matches: struct (out: array of (before, token, kind, value, pseudonym; null if nothing is replaced), tail).

    ``before`` and ``tail`` are the text between the tokens.  A value longer than its token takes the rest from what follows it.
    """
    every = _q("|".join(_numbered(k) for k in KINDS))
    plain = [k for k in KINDS if k not in HEADS]
    made = replacements(key)
    # groups: 1 the phone's separator, 2 iban, 3 card
    kind = "CASE WHEN ib[i] <> '' THEN 'iban' WHEN cd[i] <> '' THEN 'card' " + " ".join(f"WHEN g RLIKE {_q('^(?:' + _numbered(k) + ')$')} THEN '{k}'" for k in plain) + " END"
    new = "CASE kind " + " ".join(f"WHEN '{k}' THEN {made[k]}" for k in KINDS) + " END"
    part = "CASE kind " + " ".join(
        f"WHEN '{k}' THEN try_element_at(filter(transform(filter(transform(filter(sequence(1, length(cand)), e -> e = length(cand) OR substring(cand, e + 1, 1) IN (' ', '-')), "
        f"e -> left(cand, e)), e -> e RLIKE {_q(PARTS[k])}), m -> named_struct('value', m, 'pseudonym', {made[k]})), e -> e.pseudonym IS NOT NULL), -1)" for k in HEADS) + " END"
    item = _let(kind, "kind", _let("CASE kind WHEN 'iban' THEN ib[i] WHEN 'card' THEN cd[i] ELSE g END", "cand",
                "named_struct('before', ps[i], 'token', g, 'kind', kind, 'cand', cand, 'whole', " + _let("cand", "m", new) + f", 'part', {part})"))
    # over: characters that the last value takes from here on; seen: characters from here on of a candidate that was not valid,
    # within which a card counts in a usual form only
    value = ("CASE WHEN a > 0 THEN NULL WHEN f.whole IS NOT NULL AND (s = 0 OR f.kind <> 'card') THEN named_struct('value', f.cand, 'pseudonym', f.whole) "
             "ELSE f.part END")
    step = _let("greatest(x.over - length(f.before), 0)", "a", _let("greatest(x.seen - length(f.before), 0)", "s", _let(value, "v", (
        "named_struct('out', concat(x.out, array(named_struct('before', substring(f.before, x.over + 1), 'token', substring(f.token, a + 1), 'kind', f.kind, "
        "'value', v.value, 'pseudonym', v.pseudonym))), 'over', if(v IS NULL, greatest(a - length(f.token), 0), length(v.value) - length(f.token)), "
        "'seen', if(v IS NULL, greatest(greatest(s, if(a = 0, length(f.cand), 0)) - length(f.token), 0), 0))"))))
    none = "cast(array() AS array<struct<before:string,token:string,kind:string,value:string,pseudonym:string>>)"
    one_by_one = f"aggregate(fs, named_struct('out', {none}, 'over', 0, 'seen', 0), (x, f) -> {step})"
    at_once = ("named_struct('out', transform(fs, f -> named_struct('before', f.before, 'token', f.token, 'kind', f.kind, 'value', f.cand, 'pseudonym', f.whole)), "
               "'over', 0, 'seen', 0)")
    result = _let(f"if(exists(fs, f -> length(f.cand) > length(f.token)), {one_by_one}, {at_once})", "st",
                  "named_struct('out', st.out, 'tail', substring(ps[size(ps) - 1], st.over + 1))")
    for value, name in ((f"transform(ms, (g, i) -> {item})", "fs"), (f"regexp_extract_all({text}, {every}, 3)", "cd"), (f"regexp_extract_all({text}, {every}, 2)", "ib"),
                        (f"split({text}, {every}, -1)", "ps")):
        result = _let(value, name, result)
    return F.expr(_let(f"regexp_extract_all({text}, {every}, 0)", "ms", f"if(size(ms) > 0, {result}, NULL)"))


def pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text pseudonymized, and ``pii``: array of (kind, value, pseudonym) replaced.

    Who knows ``key`` can undo the pseudonyms, so it has no default.
    Rows are handled one by one, without a shuffle: nulls stay null (empty
    array), empty texts stay empty, repeated rows give equal results, and an
    empty table an empty result.  A column named ``pii`` of the input is replaced.
    Texts without a digit, "@" or a word that names a secret (MAY) hold nothing to find and are passed by.
    A card or IBAN is the longest valid candidate from its first group on: the whole run, or a prefix of it that ends at a
    separator (cards: in a usual form); the search goes on behind it, or inside a run without one.
    """
    none = "array<struct<kind:string,value:string,pseudonym:string>>"
    if not key:
        raise ValueError("pii needs a key")
    out = docs.drop("pii")
    t, s = free_name("__t", out.columns), free_name("__s", out.columns)
    out = out.withColumn(t, F.col(f"`{text_col}`"))
    out = out.withColumn(s, F.when(F.col(t).rlike(MAY), settled(key, t)))
    whole = F.expr(f"concat(array_join(transform({s}.out, o -> concat(o.before, coalesce(o.pseudonym, o.token))), ''), {s}.tail)")
    out = out.withColumn(text_col, F.when(F.col(s).isNotNull(), whole).otherwise(F.col(t)))
    found = F.expr(f"transform(filter({s}.out, o -> o.pseudonym IS NOT NULL), o -> named_struct('kind', o.kind, 'value', o.value, 'pseudonym', o.pseudonym))")
    return out.withColumn("pii", F.coalesce(found, F.array().cast(none))).drop(t, s)
