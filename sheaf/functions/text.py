"""Text functions as Column builders: everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accented Latin letters and what remains of them without their marks.
_ACCENTED = "áàâäãåāăąçćčďéèêëēėęěíìîïīįñńňóòôöõōőřśšťúùûüūůűųýÿźżž"
_PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorsstuuuuuuuuyyzzz"

# Function words that never make a passage evidence.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "ang", "ay", "ito", "kay", "mga", "na", "nang", "ng", "ni", "pa", "para", "po", "sa", "si", "yung",
)

# Words that say nothing about a file's contents.
GENERIC_WORDS = (
    "untitled", "new", "document", "doc", "docs", "file", "files", "note", "notes", "draft", "drafts", "final", "copy", "scan", "scanned", "text", "txt", "md", "temp", "tmp", "misc", "stuff",
    "version", "v", "rev", "edit", "edited", "export", "page", "memo", "of", "bago", "bagong", "dokumento", "tala", "kopya", "walang", "pamagat",
)

# The word lists that choose a response language.
FILIPINO_HINTS = ("ang", "ng", "mga", "sa", "para", "at", "ay", "ito", "iyon", "hanapin", "palitan", "deadline", "araw", "proyekto", "paki", "saan", "ibigay", "ibuod", "tala", "paano")
ENGLISH_HINTS = ("the", "a", "an", "is", "are", "find", "change", "replace", "deadline", "project", "file", "summarize", "what", "where", "how", "please")

# Month names in English, English abbreviation and Filipino.
MONTHS = (
    ("january", "jan", "enero"), ("february", "feb", "pebrero"), ("march", "mar", "marso"), ("april", "apr", "abril"), ("may", "may", "mayo"), ("june", "jun", "hunyo"),
    ("july", "jul", "hulyo"), ("august", "aug", "agosto"), ("september", "sep", "setyembre"), ("october", "oct", "oktubre"), ("november", "nov", "nobyembre"), ("december", "dec", "disyembre"),
)


def array_of(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(text: Column) -> Column:
    """Distinct tokens, sorted."""
    return F.array_sort(F.array_distinct(tokens(text)))


def fold(text: Column) -> Column:
    """Lower-cased, without accents, white space collapsed and trimmed."""
    plain = F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{M}+", "")
    return F.trim(F.regexp_replace(plain, r"[ \t\n\r\f]+", " "))


def occurrences(folded: Column, term: str) -> Column:
    """How often a term stands as a whole token (letters, digits and _ on neither side); overlapping starts count."""
    literal = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in term)
    return F.regexp_count(folded, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?={literal}(?![\p{{L}}\p{{N}}_]))"))


def mentions_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in the text with neither a letter nor a digit beside it (_ is a boundary here)."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " "), F.lit(" "))
    return F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(F.lower(phrase), r"[^\p{L}\p{N}]", " "), F.lit(" ")))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    """The folder of a path, '' at the top."""
    return F.regexp_replace(F.regexp_extract(path, r"^(?s:(.*))/[^/]*$", 1), r"/+$", "")


def folders_of(path: Column) -> Column:
    """All folders a path lies in, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def stem_of(name: Column) -> Column:
    """A name without its last extension; the whole name if it has none."""
    return F.when(name.contains("."), F.regexp_extract(name, r"^(?s:(.*))\.[^.]*$", 1)).otherwise(name)


def extension_of(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))


def slug_of(title: Column) -> Column:
    """Lower-case words joined by hyphens; letters of every script are kept."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def is_generic_stem(stem: Column) -> Column:
    """Whether every word of a stem is a generic word, a number, or at most four letters followed by digits."""
    generic = array_of(GENERIC_WORDS)
    return F.forall(tokens(stem), lambda w: F.array_contains(generic, w) | w.rlike(r"^[0-9]+$") | w.rlike(r"^[^0-9]{1,4}[0-9]+$"))


def title_of(text: Column) -> Column:
    """The first level-one heading, else the first non-blank line of at most 120 characters, else null."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    heads = F.filter(lines, lambda x: x.startswith("# "))
    short = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= 120))
    head = F.when(F.size(heads) > 0, F.trim(F.substring(heads[0], 3, 1_000_000)))
    return F.nullif(F.when(F.size(heads) > 0, head).otherwise(F.get(short, F.lit(0))), F.lit(""))


def hinted_language(text: Column) -> Column:
    """The response language two short word lists suggest: en, fil, mixed or unknown."""
    found = tokens(text)
    en, fil = F.arrays_overlap(found, array_of(ENGLISH_HINTS)), F.arrays_overlap(found, array_of(FILIPINO_HINTS))
    return F.when(en & fil, "mixed").when(en, "en").when(fil, "fil").otherwise("unknown")


def markdown_links(text: Column) -> Column:
    """The targets of [label](target) links, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1))


def linked_path(source: Column, link: Column) -> Column:
    """The path a relative link leads to from the file `source`; null for schemes, roots, bad escapes and beyond the top."""
    outside = link.rlike(r"^([/\\]|[A-Za-z]+:)")
    bare = F.regexp_extract(link, r"^([^?#]*)", 1)
    decoded = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    inside = F.when(outside | (decoded == "") | decoded.rlike(r"^([/\\]|[A-Za-z]+:)"), F.lit(None).cast("string")).otherwise(decoded)
    home = F.filter(F.split(folder_of(source), "/"), lambda p: p != "")
    steps = F.filter(F.split(inside, "/"), lambda p: (p != "") & (p != "."))
    none = F.lit(None).cast("array<string>")
    walk = F.aggregate(steps, home, lambda at, p: F.when(p != "..", F.concat(at, F.array(p))).when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1)).otherwise(none))
    return F.nullif(F.array_join(walk, "/"), F.lit(""))


def clean_name(name: Column, most: int = 60) -> Column:
    """A generated name: white space collapsed, quotes and punctuation stripped at the ends; null if empty, too long or with control characters."""
    got = F.regexp_replace(F.trim(F.regexp_replace(name, r"[ \t\n\r\f]+", " ")), r"^[\"'.,;:!? ]+|[\"'.,;:!? ]+$", "")
    return F.when((got != "") & (F.length(got) <= most) & ~got.rlike(r"[\p{Cc}\p{Cf}]"), got)


def passage_text(title: Column, path: Column, text: Column) -> Column:
    """What is embedded for a passage: title, the words of the path, the text."""
    return F.concat_ws("\n", title, F.array_join(tokens(path), " "), text)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The bytes start..end (end exclusive) of a text in UTF-8."""
    return F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int"))


def date_variants(phrase: str) -> list[str]:
    """A phrase in lower case and, if it is a month and a day, the same date with the month's other names."""
    found = [phrase.strip().lower()]
    match phrase.split():
        case [month, day] if day.isdigit() and len(day) <= 2:
            word = month.rstrip(".")
            if word.lower() != "may" or word.startswith("M"):
                for names in MONTHS:
                    if word.lower() in names:
                        found += [f"{n} {day}" for n in dict.fromkeys(names) if f"{n} {day}" not in found]
    return found


def excerpt(text: Column, folded: Column, term: str, width: int = 360, lead: int = 120) -> Column:
    """struct(start, end, text): a window of `width` characters that begins `lead` before the first hit of a term in the
    folded text (of equal length); from the beginning if there is none.  start and end are UTF-8 bytes."""
    hit = F.greatest(F.locate(term, folded), F.lit(1))
    first = F.greatest(hit - lead, F.lit(1)).cast("int")
    cut = F.substr(text, first, F.lit(width))
    start = F.octet_length(F.left(text, first - 1))
    return F.struct(start.alias("start"), (start + F.octet_length(cut)).alias("end"), cut.alias("text"))


def utf16_offset(text: Column, byte: Column) -> Column:
    """The UTF-16 offset of a byte offset at a character boundary; null elsewhere or beyond the text."""
    head = F.try_validate_utf8(byte_slice(text, F.lit(0), byte).cast("string"))
    inside = (byte >= 0) & (byte <= F.octet_length(text))
    return F.when(inside, (F.octet_length(F.encode(head, "UTF-16BE")) / 2).cast("int"))


def escape_delimiters(text: Column, words: tuple[str, ...] = ("SOURCE_BEGIN", "SOURCE_END")) -> Column:
    """A text in which the words that delimit sources in a prompt cannot stand."""
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(w.replace("_", "\\_")))
    return text


def collapsed(text: Column) -> Column:
    """Lower-cased with white space collapsed, for verbatim comparison."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " "))


def terms_in_order(text: Column, most: int = 32) -> Column:
    """Distinct tokens in the order in which they first stand, `most` at most."""
    return F.slice(F.array_distinct(tokens(text)), 1, most)


# The accented forms a plain letter is marked in.
_FORMS = {p: "".join(a for a, q in zip(_ACCENTED, _PLAIN) if q == p) for p in sorted(set(_PLAIN))}


def highlighted(text: Column, terms: list[str], whole: bool = False) -> Column:
    """array<struct<text, hit>>: the text in pieces, in order, those that match a term marked; case and accents aside.

    A term marks every word that begins with it, to the word's end; with `whole` it marks itself only, as a token of its
    own (no letter, digit or _ beside it).  One pattern per call, in the JVM.
    """
    def quoted(term: str) -> str:
        return "".join(f"[{c}{_FORMS[c]}]\\p{{M}}*" if c in _FORMS else (c if c.isalnum() else "\\" + c) + r"\p{M}*" for c in term)

    none = F.when(text != "", F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))).otherwise(F.array().cast("array<struct<text:string,hit:boolean>>"))
    if not terms:
        return none
    any_ = "|".join(quoted(t) for t in sorted(terms, key=len, reverse=True))
    edge, rest = (r"[\p{L}\p{N}_\p{M}]", "") if whole else (r"[\p{L}\p{N}\p{M}]", r"[\p{L}\p{N}\p{M}]*")
    pattern = rf"(?iu)(?<!{edge})(?:{any_}){rest}" + (rf"(?!{edge})" if whole else "")
    marked = F.regexp_replace(text, rf"({pattern})", "\u0001\u0002$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.replace(x, F.lit("\u0002"), F.lit("")).alias("text"), x.startswith("\u0002").alias("hit")))


def line_at(text: Column, position: Column) -> Column:
    """The trimmed line of a text that holds a position (characters from 1)."""
    line = F.size(F.split(F.substr(text, F.lit(1), F.greatest(position - 1, F.lit(0)).cast("int")), "\n"))
    return F.trim(F.regexp_replace(F.get(F.split(text, "\n"), line - 1), r"[ \t\r]+$", ""))


def model_json(text: Column) -> Column:
    """The JSON of a model's output: without the fence that models like to put around it; null if there is none or it is not valid."""
    bare = F.trim(F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    inner = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"(?s)^```json(.*)```$", 1), r"^\s+", ""), r"\s+$", "")
    json = F.when(bare.startswith("```json") & bare.endswith("```") & (F.length(bare) >= 10), inner).otherwise(bare)
    return F.when(F.try_parse_json(json).isNotNull(), json)


def link_ranges(text: Column) -> Column:
    """array<struct<label, target, start, end>> of the [label](target) links, in order; start and end are UTF-8 bytes.

    The pieces between the links are cut by the same pattern, so that positions add up; everything stays in the JVM.
    """
    pattern = r"\[([^\]]+)\]\(([^)]+)\)"
    whole, labels, targets = (F.regexp_extract_all(text, F.lit(pattern), F.lit(n)) for n in (0, 1, 2))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.transform(between, lambda x: F.octet_length(x)), F.transform(whole, lambda x: F.octet_length(x)), lambda a, b: F.struct(F.coalesce(a, F.lit(0)).alias("gap"), F.coalesce(b, F.lit(0)).alias("own")))
    kind = "struct<at:bigint,ends:array<struct<start:bigint,end:bigint>>>"
    begun = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("ends"))

    def add(held, x):
        start = held["at"] + x["gap"]
        end = start + x["own"]
        return F.struct(end.alias("at"), F.concat(held["ends"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("ends")).cast(kind)

    ends = F.aggregate(sizes, begun.cast(kind), add)["ends"]
    each = F.zip_with(labels, targets, lambda a, b: F.struct(a.alias("label"), b.alias("target")))
    return F.filter(F.zip_with(each, ends, lambda a, b: F.struct(a["label"].alias("label"), a["target"].alias("target"), b["start"].alias("start"), b["end"].alias("end"))), lambda x: x["label"].isNotNull())


def utf8_offset(text: Column, units: Column) -> Column:
    """The byte offset of an offset in UTF-16 units; null inside a character, before the text and beyond it."""
    wide = F.encode(text, "UTF-16BE")
    head = F.substring(wide, F.lit(1), (units * 2).cast("int"))
    # a pair cut in half ends with its first half, D800 to DBFF
    cut = F.hex(F.substring(wide, (units * 2 - 1).cast("int"), F.lit(2))).rlike("^D[89AB]")
    inside = (units >= 0) & (units * 2 <= F.octet_length(wide))
    return F.when(inside & (units == 0), F.lit(0)).when(inside & ~cut, F.octet_length(F.decode(head, "UTF-16BE")))
