"""Column expressions over names, references, addresses and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """DNS label: lower case, separators to dashes, other characters dropped, dashes collapsed, 'x' if empty."""
    step = F.translate(F.lower(F.trim(text)), "@._:", "----")
    step = F.regexp_replace(step, "[^a-z0-9-]", "")
    step = F.trim(F.regexp_replace(step, "-+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(step, F.lit("")), F.lit("x"))


def user_of_subject(subject: Column) -> Column:
    """Text after the last '#' of an identity-provider subject."""
    return F.substring_index(F.trim(subject), "#", -1)


def group_name(prefix: str, owner: Column, project: Column, role: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), slug(owner), F.lit("-"), slug(project), F.lit(":"), role)


def object_name(text: Column) -> Column:
    """Resource name: unlike slug, characters outside [a-z0-9-] become dashes instead of disappearing."""
    step = F.regexp_replace(F.lower(text), "[^a-z0-9-]", "-")
    return F.trim(F.regexp_replace(step, "-+", "-"), F.lit("-"))


def reference_tag(ref: Column) -> Column:
    """sha-<12 hex> for a digest, else the text after the last ':' of the last path part, else 'latest'."""
    digest = F.regexp_extract(ref, "@sha256:([a-f0-9]+)", 1)
    tag = F.regexp_extract(ref, ":([^/:]+)$", 1)
    return (
        F.when(digest != "", F.concat(F.lit("sha-"), F.substring(digest, 1, 12)))
        .when(tag != "", tag)
        .otherwise(F.lit("latest"))
    )


def reference_repo(ref: Column) -> Column:
    """Repository name without registry, first owner part, tag and digest."""
    base = F.regexp_replace(ref, "@sha256:.*$", "")
    base = F.when(ref.contains("@sha256:"), base).otherwise(F.regexp_replace(base, ":[^/:]+$", ""))
    base = F.regexp_replace(base, "^([^/]*[.:][^/]*|localhost)/", "")
    base = F.regexp_replace(base, "^[^/]*/", "")
    return F.regexp_replace(F.translate(base, "/:@", "---"), "[^A-Za-z0-9._-]", "")


def url_scheme(url: Column) -> Column:
    return F.when(url.startswith("https://"), F.lit("https")).otherwise(F.lit("http"))


def url_host(url: Column) -> Column:
    """Host without scheme, port, path, query or fragment."""
    return F.regexp_extract(url, "^(?:https?://)?([^:/?#]*)", 1)


def code_epoch(code: Column) -> Column:
    """Creation time carried in a code like NAME-1700000000-3."""
    digits = F.regexp_extract(code, "-([0-9]{9,})-[0-9]+$", 1)
    return F.when(digits != "", F.timestamp_seconds(digits.try_cast("bigint")))


def age_seconds(text: Column) -> Column:
    """Seconds in an age like 2d3h, 3m19s or 26s."""
    def part(unit: str, seconds: int) -> Column:
        digits = F.regexp_extract(text, f"([0-9]+){unit}", 1)
        return F.when(digits != "", digits.try_cast("bigint") * seconds).otherwise(F.lit(0))

    total = part("d", 86400) + part("h", 3600) + part("m", 60) + part("s", 1)
    return F.when(text.rlike("^([0-9]+[dhms])+$"), total)


def call_outcome(method: Column, status: Column) -> Column:
    """What a status code means for a call: present, absent, done or error."""
    return (
        F.when((method == "GET") & (status == 404), "absent")
        .when((method == "GET") & (status == 200), "present")
        .when((method == "POST") & (status == 201), "done")
        .when((method == "PATCH") & (status == 200), "done")
        .when((method == "DELETE") & status.isin(204, 404), "done")
        .otherwise("error")
    )
