"""Postings from captured board payloads.

A capture is a row (ats, board, company, part, key, payload): part is "list" for a listing page and "detail" for one
posting, key is the page's place or the posting's id. Each connector is a parse of listings, and, where a listing
has no bodies, a join with its details.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.functions import kernels
from veilsift.operators.rollup import first_per_board

POSTING = ("company", "ats", "board", "job_id", "title", "url", "jd_html")

#: Boards without bodies in their listings are read no further than this unless told otherwise.
DEFAULT_MOST = 60


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def either(a: Column, b: Column) -> Column:
    """a, or b where a is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def posting(rows: DataFrame, job_id: Column, title: Column, url: Column, body: Column) -> DataFrame:
    """Rows in the shape of postings, with the place they have on their board."""
    return rows.select(
        F.coalesce(F.nullif("company", F.lit("")), "board").alias("company"), "ats", "board", F.coalesce(job_id, F.lit("None")).alias("job_id"),
        F.left(_blank(title), F.lit(160)).alias("title"), _blank(url).alias("url"), _blank(body).alias("jd_html"), "page", "place",
    )


def _listed(captures: DataFrame, path: str | None, item: str) -> DataFrame:
    """A row per listed item. path: the field that holds the array, None if the payload is one."""
    kind = f"array<{item}>" if path is None else f"struct<{path}:array<{item}>>"
    parsed = F.from_json("payload", kind)
    rows = captures.where("part = 'list'").withColumn("page", F.try_to_number("key", F.lit("9999999999")).cast("long"))
    return rows.select("ats", "board", "company", "page", F.posexplode(parsed if path is None else parsed[path]).alias("place", "j"))


def _detailed(captures: DataFrame, listed: DataFrame, key: Column, item: str) -> DataFrame:
    details = captures.where("part = 'detail'").select("ats", "board", F.col("key").alias("k"), F.from_json("payload", item).alias("d"))
    wanted = listed.withColumn("k", key).where("k IS NOT NULL AND k <> ''")
    return wanted.join(details, ["ats", "board", "k"]).where("d IS NOT NULL")


def greenhouse(captures: DataFrame) -> DataFrame:
    rows = _listed(captures, "jobs", "struct<id:string,title:string,absolute_url:string,content:string>")
    return posting(rows, F.col("j.id"), F.col("j.title"), F.col("j.absolute_url"), kernels.unescape_entities(_blank(F.col("j.content"))))


def ashby(captures: DataFrame) -> DataFrame:
    rows = _listed(captures, "jobs", "struct<id:string,title:string,jobUrl:string,applyUrl:string,descriptionHtml:string,descriptionPlain:string>")
    return posting(rows, F.col("j.id"), F.col("j.title"), either(F.col("j.jobUrl"), F.col("j.applyUrl")), either(F.col("j.descriptionHtml"), F.col("j.descriptionPlain")))


def lever(captures: DataFrame) -> DataFrame:
    rows = _listed(captures, None, "struct<id:string,text:string,hostedUrl:string,applyUrl:string,description:string,descriptionPlain:string,additional:string,lists:array<struct<text:string,content:string>>>")
    lists = F.array_join(F.transform(F.coalesce("j.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda s: F.concat(F.lit(" "), _blank(s["text"]), F.lit(" "), _blank(s["content"]))), "")
    body = F.concat(_blank(either(F.col("j.description"), F.col("j.descriptionPlain"))), lists, F.lit(" "), _blank(F.col("j.additional")))
    return posting(rows, F.col("j.id"), F.col("j.text"), either(F.col("j.hostedUrl"), F.col("j.applyUrl")), body)


def recruitee(captures: DataFrame) -> DataFrame:
    rows = _listed(captures, "offers", "struct<id:string,title:string,careers_url:string,description:string>")
    return posting(rows, F.col("j.id"), F.col("j.title"), F.col("j.careers_url"), F.col("j.description"))


def smartrecruiters(captures: DataFrame) -> DataFrame:
    section = "struct<text:string>"
    item = f"struct<name:string,applyUrl:string,jobAd:struct<sections:struct<jobDescription:{section},qualifications:{section},additionalInformation:{section},companyDescription:{section}>>>"
    rows = _detailed(captures, _listed(captures, "content", "struct<id:string>"), F.col("j.id"), item)
    parts = [F.nullif(F.col(f"d.jobAd.sections.{s}.text"), F.lit("")) for s in ("jobDescription", "qualifications", "additionalInformation", "companyDescription")]
    return posting(rows, F.col("k"), F.col("d.name"), F.col("d.applyUrl"), F.concat_ws(" ", *parts))


def workday(captures: DataFrame) -> DataFrame:
    """The board is host::tenant::site; any other has no postings."""
    names = F.split("board", "::", -1)
    rows = _detailed(captures.where(F.size(names) == 3), _listed(captures.where(F.size(names) == 3), "jobPostings", "struct<externalPath:string>"), F.col("j.externalPath"), "struct<jobPostingInfo:struct<id:string,title:string,externalUrl:string,jobDescription:string>>")
    rows = rows.withColumn("company", F.coalesce(F.nullif("company", F.lit("")), names[1]))
    info = "d.jobPostingInfo"
    return posting(rows, either(F.col(f"{info}.id"), F.col("k")), F.col(f"{info}.title"), F.col(f"{info}.externalUrl"), F.col(f"{info}.jobDescription"))


def workable(captures: DataFrame) -> DataFrame:
    rows = _detailed(captures, _listed(captures, "results", "struct<shortcode:string>"), F.col("j.shortcode"), "struct<title:string,url:string,application_url:string,description:string,requirements:string,benefits:string>")
    parts = [F.nullif(F.col(f"d.{s}"), F.lit("")) for s in ("description", "requirements", "benefits")]
    return posting(rows, F.col("k"), F.col("d.title"), either(F.col("d.url"), F.col("d.application_url")), F.concat_ws(" ", *parts))


CONNECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "greenhouse": greenhouse, "ashby": ashby, "lever": lever, "recruitee": recruitee,
    "smartrecruiters": smartrecruiters, "workday": workday, "workable": workable,
}
BULK = frozenset({"greenhouse", "ashby", "lever", "recruitee"})


def postings(captures: DataFrame, ats: str, most: int | None = None) -> DataFrame:
    """Postings of all boards of one system; of each board the first `most`, by place in its listing."""
    if ats not in CONNECTORS:
        raise ValueError(f"unknown board system: {ats}")
    if most is None and ats not in BULK:
        most = DEFAULT_MOST
    rows = CONNECTORS[ats](captures.where(F.col("ats") == ats))
    return (rows if most is None else first_per_board(rows, most, "page", "place")).select(*POSTING)


def all_postings(captures: DataFrame, most: int | None = None) -> DataFrame:
    out = None
    for ats in CONNECTORS:
        rows = postings(captures, ats, most)
        out = rows if out is None else out.unionByName(rows)
    return out


def errors(captures: DataFrame) -> DataFrame:
    """Boards whose capture is a failure (part "error", the payload says which) or a system that isn't known."""
    unknown = F.when(~F.col("ats").isin(*CONNECTORS), F.concat(F.lit("ValueError: unknown board system: "), F.col("ats")))
    said = F.when(F.col("part") == "error", F.col("payload")).otherwise(unknown)
    return captures.select(F.coalesce(F.nullif("company", F.lit("")), "board").alias("company"), "ats", "board", said.alias("error")).where("error IS NOT NULL").distinct()
