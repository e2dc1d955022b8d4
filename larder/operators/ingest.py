"""Ingest: validation of captures, classification of URLs, hashes, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import origin, path

#: The forms of what comes from outside.
HANDLE, CURSOR, COLLECTION_ID, USER_ID, PLATFORM = r"^[A-Za-z0-9._]{1,64}$", r"^\d{1,16}$", r"^\d{1,24}$", r"^\d{1,24}$", r"^[a-z][a-z0-9_-]{0,31}$"
#: The envelope's own name and version, the longest body, and how far a capture's clock may be off.
CHANNEL, VERSION, MOST_BODY_CHARS, MOST_SKEW_MS = "larder:capture", 1, 12_000_000, 600_000
ENVELOPE = (
    "channel string, v int, platform string, kind string, request_cursor string, collection_id string, captured_at long, body string, "
    "page_handle string, viewer_handle string, viewer_id string"
)
_OPTIONAL = {"request_cursor": CURSOR, "collection_id": COLLECTION_ID, "page_handle": HANDLE, "viewer_handle": HANDLE, "viewer_id": USER_ID}


def _fits(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(pattern), F.lit(False))


def validate_captures(captures: DataFrame, rules: DataFrame, now: Column, skew_ms: int = MOST_SKEW_MS, most_chars: int = MOST_BODY_CHARS, carried: tuple[str, ...] = ()) -> DataFrame:
    """The envelope's known fields, ``carried`` columns and ``reason``: the first check that fails, or null.

    ``rules`` (platform, kind) says what may be captured. In order: malformed (channel, version, form of the platform),
    wrong_platform, unknown_kind, malformed (a cursor, id or handle that is given but ill-formed, or no time), stale,
    malformed (no body), too_large. The result has these columns alone."""
    known = F.broadcast(rules.groupBy("platform").agg(F.collect_set("kind").alias("_kinds")))  # one short row a platform
    envelope = _fits(F.col("channel"), f"^{CHANNEL}$") & F.coalesce(F.col("v") == VERSION, F.lit(False)) & _fits(F.col("platform"), PLATFORM)
    given = F.lit(True)
    for name, pattern in _OPTIONAL.items():
        given = given & (F.col(name).isNull() | _fits(F.col(name), pattern))
    reason = (
        F.when(~envelope, "malformed").when(F.col("_kinds").isNull(), "wrong_platform").when(~F.coalesce(F.array_contains("_kinds", F.col("kind")), F.lit(False)), "unknown_kind")
        .when(~given | F.col("captured_at").isNull(), "malformed").when(F.abs(now - F.col("captured_at")) > skew_ms, "stale")
        .when(F.coalesce(F.length("body"), F.lit(0)) == 0, "malformed").when(F.length("body") > most_chars, "too_large")
    )
    fields = [c.split()[0] for c in ENVELOPE.split(", ")]
    return captures.join(known, "platform", "left").select(*fields, *carried, reason.alias("reason"))


def filter_origins(rows: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose URL has the scheme and host of one of ``patterns`` (``https://host/*``); ``*.host`` is the host and all below
    it. A port never matches."""
    at, fits = origin(F.col(column)), F.lit(False)
    for p in patterns:
        scheme, _, rest = p.lower().partition("://")
        name = rest.partition("/")[0]
        base = name.removeprefix("*.")
        fits = fits | (at == f"{scheme}://{base}")
        if name != base:
            fits = fits | (at.startswith(f"{scheme}://") & at.endswith(f".{base}"))
    return rows.filter(F.coalesce(fits, F.lit(False)))


def classify_requests(rows: DataFrame, column: str, rules: DataFrame, at: str) -> DataFrame:
    """``rows`` with kind, cursor and item_list of requests that ``rules`` (path, kind) name, at the exact origin ``at``; null for
    all others. Of the query only a cursor and a collection id of digits are kept."""
    url = F.col(column)
    asked = lambda key, form: F.when(F.col("kind").isNotNull(), F.when(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)).rlike(form), F.try_parse_url(url, F.lit("QUERY"), F.lit(key))))
    named = rows.withColumn("_path", F.when(origin(url) == at, path(url)))
    found = named.join(F.broadcast(rules.select(F.col("path").alias("_path"), "kind")), "_path", "left")  # a few rules
    return found.withColumn("request_cursor", asked("cursor", CURSOR)).withColumn("collection_id", asked("collectionId", COLLECTION_ID)).drop("_path")


#: Paths of the platform's own pages, and the forms of profile and collection paths.
HOME_PATHS = ("/", "/foryou", "/following", "/explore")
OWNER_PATH, PROFILE_PATH, COLLECTION_PATH = r"^/@([^/?#]+)(?:/|$)", r"^/@[^/]+/?$", r"^/@[^/]+/collection/[^/]*?(\d{6,})/?$"


def classify_page(at: Column) -> Column:
    """kind, handle and collection_id of a page's path: a profile's collection (a number of six digits or more at the end of its
    name), a profile, home or other. A handle that is ill-formed isn't given."""
    raw = F.try_url_decode(F.regexp_extract(at, OWNER_PATH, 1))
    collection = F.nullif(F.regexp_extract(at, COLLECTION_PATH, 1), F.lit(""))
    kind = F.when(collection.isNotNull(), "collection").when(at.rlike(PROFILE_PATH), "profile").when(at.isin(*HOME_PATHS), "home").otherwise("other")
    handle = F.when(kind.isin("collection", "profile") & _fits(raw, HANDLE), raw)
    return F.struct(kind.alias("kind"), handle.alias("handle"), collection.alias("collection_id"))


def content_hash(columns: list[str]) -> Column:
    """A hash of exactly the searchable text, for change detection. Lists, such as tags, count in order; a null is none."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def capture_metrics(pages: DataFrame, by: list[str]) -> DataFrame:
    """Counters of pages (reason if refused, items, inserted, touched, reindexed, captured_at, page): accepted and rejected
    pages, duplicates (items, but all seen before), sums, and the last accepted page."""
    ok = F.col("reason").isNull()
    sums = [F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("items", "inserted", "touched", "reindexed")]
    again = ok & (F.col("items") > 0) & (F.col("inserted") == 0)
    last = F.max_by("page", F.when(ok, F.struct("captured_at", "page")))
    return pages.groupBy(*by).agg(F.count_if(ok).alias("pages"), F.count_if(~ok).alias("rejected"), F.count_if(again).alias("duplicates"), *sums, last.alias("last_page"))


def rejection_counts(pages: DataFrame) -> DataFrame:
    """reason, n of refused pages."""
    return pages.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def identity_reason(viewer: Column, page_owner: Column, payload_owner: Column, account: Column | None = None) -> Column:
    """Why a capture isn't of the viewer's own data, or null. Handles are compared without case; a payload may name nobody.

    ``account`` says how the viewer stands to the account that is bound (``query.match_account``), if one is."""
    same = lambda a, b: F.coalesce(F.lower(a) == F.lower(b), F.lit(False))
    reason = F.when(F.coalesce(viewer, F.lit("")) == "", "no_viewer").when(~same(viewer, page_owner), "not_own_page").when(payload_owner.isNotNull() & ~same(viewer, payload_owner), "not_own_data")
    return reason if account is None else reason.when(account == "different", "other_account")


def valid_account(handle: Column, identifier: Column, platform: Column | None = None) -> Column:
    """Well-formed handle, no identifier or a well-formed one, and a well-formed platform if one is given."""
    ok = _fits(handle, HANDLE) & F.coalesce(identifier.rlike(USER_ID), F.lit(True))
    return ok if platform is None else ok & _fits(platform, PLATFORM)


def search_docs(items: DataFrame, names: DataFrame, key: str, sound: tuple[str, ...] = ()) -> DataFrame:
    """key and five texts of each item: caption, hashtags, author, sound, and its collections' names (key, name) in order."""
    named = names.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("_names"))
    words = lambda *columns: F.concat_ws(" ", *columns)
    return items.join(named, key, "left").select(
        key, F.coalesce("caption", F.lit("")).alias("caption_text"), words("hashtags").alias("hashtags_text"), words("author_handle").alias("author_text"),
        (words(*sound) if sound else F.lit("")).alias("sound_text"), F.coalesce("_names", F.lit("")).alias("collections_text"),
    )


def canonical_url(base: str, handle: Column, media_type: Column, external_id: Column) -> Column:
    """A link back to the post; null without a handle or id."""
    return F.concat(F.lit(f"{base}/@"), F.nullif(handle, F.lit("")), F.lit("/"), F.coalesce(media_type, F.lit("video")), F.lit("/"), external_id)


def inconsistent_docs(stored: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """key, problem: search documents that are missing, left over or different from what the items give now."""
    columns = [c for c in computed.columns if c != key]
    pack = lambda df, name: df.select(key, F.struct(*columns).alias(name))
    both = pack(stored, "_s").join(pack(computed, "_c"), key, "full_outer")
    problem = F.when(F.col("_s").isNull(), "missing").when(F.col("_c").isNull(), "left_over").when(~F.col("_s").eqNullSafe(F.col("_c")), "different")
    return both.select(key, problem.alias("problem")).filter("problem IS NOT NULL")
