"""Column functions that normalise the values of tender portals; no Python runs per row.

White space is Unicode white space, digits are ASCII digits. Missing or
unreadable values become null, never a default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distance import edits, word_counts, word_edits
from .fixed import CLEAN_TOKEN, CORRUPT_NOISE, CORRUPT_SHARE, CORRUPT_TOKENS, FIELD_ALIASES, MISSING, OWN_TEXT, PROBE_NOISE, SITE_INDEX, SITE_ROOT, TABLE_KEYWORDS, TOKEN

SPACE = r"(?U)\s+"
#: Legal forms as words of their own, in upper case with two spaces between words.
LEGAL_FORMS = r" (SOCIÉTÉ|SOCIETE|STE|SARL  AU|SARL|S\.A\.R\.L|SA)\.? "
AMOUNTS, FLAGS = ("estimation_dhs_ttc", "caution_provisoire"), ("allotissement", "reserve_tpe_pme")
DATE = r"\b\d{2}/\d{2}/\d{4}\b"


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(c, SPACE, " "))


def normalize_label(c: Column) -> Column:
    """A label without extra space or footnote stars; null becomes empty."""
    return F.btrim(F.rtrim(squeeze(F.coalesce(c, F.lit(""))), F.lit("*")))


def clean_value(c: Column) -> Column:
    """A value without decoration; markers of absence become null."""
    return present(undecorated(squeeze(c)))


def undecorated(squeezed: Column) -> Column:
    return F.btrim(F.btrim(F.btrim(F.replace(squeezed, F.lit("@@@@"), F.lit(""))), F.lit("*")))


def present(bare: Column) -> Column:
    """Null for markers of absence."""
    return F.when(~F.lower(bare).isin(*MISSING), bare)


def amount_digits(clean: Column) -> Column:
    """The digits and marks of a cleaned value."""
    return F.regexp_replace(clean, r"[^0-9,.\-]", "")


def amount_bare(digits: Column) -> Column:
    """Digits with dots only: of two kinds of separators the last is decimal."""
    last = lambda mark: F.locate(mark, F.reverse(digits))  # from the end; 0: absent
    comma, dot = last(","), last(".")
    return (
        F.when((comma > 0) & (dot > 0) & (comma < dot), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((comma > 0) & (dot > 0), F.replace(digits, F.lit(","), F.lit("")))
        .otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    )


def amount_of(bare: Column) -> Column:
    """The double of digits with dots only; several dots are thousands."""
    whole = F.when(F.regexp_count(bare, F.lit(r"\.")) > 1, F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
    return F.when(whole.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), whole.try_cast("double"))


def parse_amount(c: Column) -> Column:
    """An amount as double: of two kinds of separators the last is decimal; several dots are thousands."""
    return amount_of(amount_bare(amount_digits(clean_value(c))))


def parse_date(c: Column) -> Column:
    """The first dd/mm/yyyy of a text; null if that is no calendar date, whatever follows."""
    return F.try_to_date(null_if_empty(F.regexp_extract(c, DATE, 0)), "dd/MM/yyyy")


def tri_state(c: Column) -> Column:
    """Oui/yes: true; non/no: false; anything else: null."""
    return flag_of(F.lower(clean_value(c)))


def flag_of(low: Column) -> Column:
    """The same of a cleaned value in lower case."""
    return F.when(low.startswith("oui") | low.startswith("yes"), True).when(low.startswith("no"), False)


def label_field(c: Column) -> Column:
    """The field whose alias a label starts with; the first alias in order wins."""
    return field_of(F.lower(normalize_label(c)))


def field_of(low: Column) -> Column:
    """The same of a normalised label in lower case: a column of its own, for each alias looks at it."""
    out = F
    for field, aliases in FIELD_ALIASES.items():
        for alias in aliases:
            out = out.when(F.startswith(low, F.lit(alias.lower())), field)
    return out


def split_label(block: Column) -> tuple[Column, Column]:
    """(label, value) around the first colon; "Référence X" needs none."""
    head = r"^(Référence|Reference)(?U:\s+)(.+)$"
    bare = F.btrim(block)
    colon = F.locate(":", block)
    label = F.when(colon > 0, F.substring_index(block, ":", 1)).when(bare.rlike(head), F.regexp_extract(bare, head, 1))
    value = F.when(colon > 0, F.substr(block, colon + 1)).when(bare.rlike(head), F.regexp_extract(bare, head, 2))
    return label, value


def typed_text(field: Column, cleaned: Column, amount: Column, day: Column, flag: Column) -> Column:
    """A cleaned value as the text of its field's type: amounts, dates, booleans, procedure before the pipe. Columns of their own, for each is looked at often."""
    return (
        F.when(field.isin(*AMOUNTS), F.when(amount.isNotNull(), F.format_string("%.2f", amount)))
        .when(field.isin(*FLAGS), flag.cast("string"))
        .when(field == "date_limite_remise_plis", F.date_format(day, "yyyy-MM-dd"))
        .when(field == "mode_passation", before_pipe(cleaned))
        .otherwise(cleaned)
    )


def before_pipe(c: Column) -> Column:
    return null_if_empty(F.btrim(F.substring_index(c, "|", 1)))


def normalize_reference(c: Column) -> Column:
    """A loose key of a reference: no space, upper case, no marks at the ends."""
    return null_if_empty(F.btrim(F.upper(F.regexp_replace(c, SPACE, "")), F.lit("-/.")))


def url_keys(url: Column) -> tuple[Column, Column]:
    """(refConsultation, orgAcronyme) of a link."""
    return null_if_empty(F.regexp_extract(url, r"refConsultation=(\d+)", 1)), null_if_empty(F.regexp_extract(url, r"orgAcronyme=([^&\"']+)", 1))


def absolute_url(href: Column) -> Column:
    return F.when(href.startswith("http"), href).when(href.startswith("?"), F.concat(F.lit(SITE_INDEX), href)).otherwise(F.concat(F.lit(SITE_ROOT), F.ltrim(href, F.lit("/"))))


def detail_url(ref: Column, org: Column) -> Column:
    """The detail page of a consultation; null if a key is missing."""
    return F.concat(F.lit(SITE_INDEX + "?page=entreprise.EntrepriseDetailConsultation&refConsultation="), ref, F.lit("&orgAcronyme="), org)


def result_count(html: Column) -> Column:
    """The number after "Nombre de résultats"; null if absent."""
    return F.regexp_replace(null_if_empty(F.regexp_extract(html, r"[Nn]ombre de r.sultats\s*:?\s*([\d\s\u00A0\u202F]{1,12})", 1)), r"[^0-9]", "").try_cast("int")


def labelled(blob: Column, labels: list[str], cut: str = r"( {2,}|Procédure|Acheteur public).*$") -> Column:
    """The value after the first of several labels in a blob of blocks joined by pipes."""
    found = [null_if_empty(F.btrim(F.regexp_replace(F.btrim(F.regexp_extract(blob, label + r"(?U:\s*):(?U:\s*)([^|]{1,180})", 1), F.lit(" :")), cut, ""))) for label in labels]
    return F.coalesce(*found)


def corrupted(text: Column) -> Column:
    """Whether extracted text is unusable: many malformed tokens, or stray brackets, braces, pipes and backslashes."""
    t = F.coalesce(text, F.lit(""))
    tokens = F.filter(F.regexp_extract_all(t, F.lit(f"(?U)({TOKEN})"), F.lit(1)), lambda x: x.rlike(r"\p{L}"))
    bad = F.size(F.filter(tokens, lambda x: ~x.rlike(CLEAN_TOKEN)))
    noise = F.regexp_count(t, F.lit(PROBE_NOISE)) / F.greatest(F.length(t) / 1000, F.lit(0.1))
    return ((F.size(tokens) >= CORRUPT_TOKENS) & (bad / F.greatest(F.size(tokens), F.lit(1)) > CORRUPT_SHARE)) | (noise > CORRUPT_NOISE)


def native_usable(text: Column) -> Column:
    """Whether a page's own text layer may be used instead of OCR."""
    return (F.length(F.coalesce(text, F.lit(""))) > OWN_TEXT) & ~corrupted(text)


def effective_dpi(points: Column, dpi: int = 300, longest: int = 4000) -> Column:
    """The resolution that keeps a page's longest side within a number of pixels."""
    inches = points / 72
    return F.when((points > 0) & (inches * dpi > longest), F.floor(longest / inches)).otherwise(dpi).cast("int")


def has_table_words(text: Column) -> Column:
    return F.lower(text).rlike("|".join(TABLE_KEYWORDS))


def normalize_company(name: Column) -> Column:
    """A company name without legal form, case or extra space."""
    spaced = F.concat(F.lit(" "), F.replace(F.upper(squeeze(name)), F.lit(" "), F.lit("  ")), F.lit(" "))
    return null_if_empty(squeeze(F.regexp_replace(spaced, LEGAL_FORMS, " ")))


def consortium(name: Column) -> Column:
    """The companies of a consortium; a single name gives itself."""
    bare = F.regexp_replace(squeeze(name), r"(?i)^groupement\s*:?\s*", "")
    parts = F.transform(F.split(bare, r"(?i)\s+et\s+|\s*/\s*|\s*;\s*|\s+&\s+"), lambda x: F.btrim(x))
    grouped = name.rlike(r"(?i)^\s*groupement\b")
    return F.when(grouped, F.filter(parts, lambda x: x != "")).otherwise(F.array(squeeze(name)))


def award_status(text: Column) -> Column:
    """ATTRIBUE, INFRUCTUEUX or OFFRE_EXCESSIVE from the wording of minutes; null if nothing is said."""
    low = F.lower(text)
    return F.when(low.rlike(r"infructueu"), "INFRUCTUEUX").when(low.rlike(r"offre[s]?\s+(est\s+|sont\s+)?excessi"), "OFFRE_EXCESSIVE").when(low.rlike(r"(concurrent|prestataire|soumissionnaire)\w*\s+(retenu|attributaire)|attribué"), "ATTRIBUE")


def strip_arabic(text: Column) -> Column:
    """Text without Arabic letters and direction marks, with single spaces."""
    return squeeze(F.regexp_replace(text, r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF\u200E\u200F\u202A-\u202E\u2066-\u2069]", " "))


def share_text(part: Column, total: Column) -> Column:
    """"n (p%)" without decimals, halves to the even number; "-" if there is nothing."""
    percent = F.bround(part / F.nullif(total, F.lit(0)) * 100, 0).cast("long")
    return F.when(total == 0, "-").otherwise(F.concat(part.cast("string"), F.lit(" ("), percent.cast("string"), F.lit("%)")))


def page_url(page: Column, flags: Column, params: dict[str, Column]) -> Column:
    """The address of a portal page: encoded parameters, then bare flags; null or no flags add nothing."""
    pairs = [F.concat(F.lit(f"&{k}="), F.url_encode(v)) for k, v in params.items()]
    bare = F.when(F.coalesce(flags, F.lit("")) != "", F.concat(F.lit("&"), flags)).otherwise("")
    return F.concat(F.lit(SITE_INDEX + "?page="), F.url_encode(page), *pairs, bare)


def character_errors(truth: Column, read: Column) -> Column:
    """Edits of characters between two whole texts, exactly."""
    return edits(truth, read)


def word_errors(truth: Column, read: Column) -> Column:
    """Edits of words between two whole texts, exactly."""
    return word_edits(truth, read)


def word_count(text: Column) -> Column:
    return word_counts(text)
