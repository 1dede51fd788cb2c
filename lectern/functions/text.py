"""Text functions as Column -> Column; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose links count as code.
CODE_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "huggingface.co")


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters or digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]{2,}"), F.lit(0))


def collapsed(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_query(text: Column) -> Column:
    return F.lower(collapsed(text))


def split_anchors(text: Column, most: int = 20, shortest: int = 3) -> Column:
    """Topics between commas, semicolons and line ends; the whole text if fewer than two are long enough."""
    parts = F.transform(F.split(text, "[,;\n]"), lambda p: F.trim(p))
    topics = F.slice(F.filter(parts, lambda p: F.length(p) >= shortest), 1, most)
    return F.when(F.size(topics) >= 2, topics).otherwise(F.array(text))


def slug(text: Column, words: int = 6, prefix: str = "adopted-") -> Column:
    """The first words of a text in small ASCII letters and digits, joined by hyphens."""
    found = F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), 1, words)
    return F.concat(F.lit(prefix), F.array_join(found, "-"))


def code_url(text: Column) -> Column:
    """The first link to a code host, without a full stop or colon at its end; null if there is none or it is over 512 long."""
    pattern = "(?i)https?://(?:www\\.)?(?:" + "|".join(h.replace(".", "\\.") for h in CODE_HOSTS) + ")/[^\\s\"'<>,;)\\]}]+"
    found = F.regexp_replace(F.regexp_extract(text, pattern, 0), "[.:]+$", "")
    return F.when((found != "") & (F.length(found) <= 512), found)


def github_repo(url: Column) -> Column:
    """owner/repository of a GitHub link; null without both."""
    found = F.regexp_extract(url, r"(?i)github\.com/([^/\s?#]+/[^/\s?#]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(found, "[.,;:)]+$", ""), r"\.git$", "")
    return F.when((bare != "") & ~bare.endswith("/"), bare)


def versioned_id(raw: Column) -> Column:
    """struct(id, version): "2401.00001v3" is version 3, an id without a version is version 1."""
    version = F.regexp_extract(raw, r"^(.+?)v(\d+)$", 2)
    with_version = version != ""
    number = F.when(with_version, version.try_cast("int")).otherwise(F.lit(1))
    return F.struct(F.when(with_version, F.regexp_extract(raw, r"^(.+?)v(\d+)$", 1)).otherwise(raw).alias("id"), number.alias("version"))


def joined_authors(names: Column) -> Column:
    return F.array_join(names, "; ")


def split_authors(authors: Column) -> Column:
    return F.split(authors, "; ")


def author_name(forenames: Column, keyname: Column) -> Column:
    """Forenames before the key name, which stands alone without them."""
    return F.when(F.coalesce(F.trim(forenames), F.lit("")) == "", F.trim(keyname)).otherwise(F.concat_ws(" ", F.trim(forenames), F.trim(keyname)))


def truncated(text: Column, length: int, mark: str = "") -> Column:
    """At most length characters, with a mark if something was cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


#: Archives that are harvested in the physics group.
PHYSICS_ARCHIVES = ("astro-ph", "cond-mat", "gr-qc", "hep-ex", "hep-lat", "hep-ph", "hep-th", "math-ph", "nlin", "nucl-ex", "nucl-th", "physics", "quant-ph")


def harvest_set(category: Column) -> Column:
    """The set a category is harvested in: its archive, in the physics group if it belongs there."""
    archive = F.substring_index(category, ".", 1)
    return F.when(archive.isin(*PHYSICS_ARCHIVES), F.concat(F.lit("physics:"), archive)).otherwise(archive)


def url_component(text: Column) -> Column:
    """Percent-encoded, with %20 for a blank."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def query_url(base: str, category: Column, since: Column, until: Column, start: Column, size: int) -> Column:
    """The address of a page of a category's papers submitted in a span of time, oldest first."""
    asked = F.format_string("cat:%s AND submittedDate:[%s TO %s]", category, since, until)
    return F.concat(F.lit(f"{base}?search_query="), url_component(asked), F.lit("&start="), start.cast("string"), F.lit(f"&max_results={size}&sortBy=submittedDate&sortOrder=ascending"))


def abs_url(paper: Column) -> Column:
    return F.concat(F.lit("http://arxiv.org/abs/"), paper)


def pdf_url(paper: Column) -> Column:
    return F.concat(F.lit("http://arxiv.org/pdf/"), paper)


#: Capital letters and digits that can't be taken for each other.
UNAMBIGUOUS = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def invite_code(key: Column, length: int = 8) -> Column:
    """A code of unambiguous letters, drawn by a checksum of a key that is kept secret: two hexadecimal digits for each letter."""
    digest = F.sha2(key.cast("binary"), 256)
    letter = lambda k: F.substring(F.lit(UNAMBIGUOUS), F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int") % len(UNAMBIGUOUS) + 1, F.lit(1))
    return F.concat(*(letter(k) for k in range(length)))


def code_list(csv: Column) -> Column:
    """The distinct trimmed parts of a comma-separated list, in order; empty parts go."""
    return F.array_distinct(F.filter(F.transform(F.split(csv, ","), lambda p: F.trim(p)), lambda p: p != ""))


def masked(key: Column) -> Column:
    return F.concat(F.lit("..."), F.right(key, F.lit(4)))


def document_text(title: Column, abstract: Column, separator: str = ". ") -> Column:
    return F.concat(title, F.lit(separator), abstract)


def fnv1a_32(text: Column) -> Column:
    """FNV-1a over the code points of a text, as a long."""
    prime, mask = 16777619, 0xFFFFFFFF
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(prime)).bitwiseAND(F.lit(mask)))
