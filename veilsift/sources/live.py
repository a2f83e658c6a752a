"""Captures of live boards: the requests that listings and details take, sent by http.fetch and kept in a folder.

Every round is one table of requests over all boards together: first pages, next pages of boards that have some, then
details. Answers go to a Parquet table in the folder before anything reads them, so nothing is asked twice, not
within a run, nor by another one over the same folder.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.operators.rollup import first_per_board
from veilsift.sources import boards, http

# Where each system lists its postings and tells of one, what is posted to it, and postings a page.
LISTINGS = {
    "greenhouse": ("GET", "https://boards-api.greenhouse.io/v1/boards/{board}/jobs?content=true", None, None),
    "ashby": ("GET", "https://api.ashbyhq.com/posting-api/job-board/{board}?includeCompensation=true", None, None),
    "lever": ("GET", "https://api.lever.co/v0/postings/{board}?mode=json", None, None),
    "recruitee": ("GET", "https://{board}.recruitee.com/api/offers/", None, None),
    "smartrecruiters": ("GET", "https://api.smartrecruiters.com/v1/companies/{board}/postings?limit=100&offset={offset}", None, 100),
    "workday": ("POST", "https://{host}/wday/cxs/{tenant}/{site}/jobs", '{"appliedFacets": {}, "limit": 20, "offset": {offset}, "searchText": ""}', 20),
    "workable": ("POST", "https://apply.workable.com/api/v3/accounts/{board}/jobs", '{"query": "", "location": []}', None),
}
DETAILS = {
    "smartrecruiters": "https://api.smartrecruiters.com/v1/companies/{board}/postings/{id}",
    "workday": "https://{host}/wday/cxs/{tenant}/{site}{id}",
    "workable": "https://apply.workable.com/api/v3/accounts/{board}/jobs/{id}",
}
#: The array of a listing whose items have details, and the field that names them.
LISTED = {"smartrecruiters": ("content", "id"), "workday": ("jobPostings", "externalPath"), "workable": ("results", "shortcode")}


def _filled(template: str | None, **values: Column) -> Column:
    """A template with its names replaced; parts of a workday board are told by ::."""
    parts = {n: F.get(F.split("board", "::", -1), F.lit(i)) for i, n in enumerate(("host", "tenant", "site"))}
    known = {"board": F.col("board"), **parts, **values}
    return reduce(lambda t, n: F.replace(t, F.lit("{" + n + "}"), known[n]), [n for n in known if "{" + n + "}" in (template or "")], F.lit(template).cast("string"))


def _by_system(choices: dict[str, Column]) -> Column:
    return reduce(lambda c, kv: c.when(F.col("ats") == kv[0], kv[1]), choices.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def listing_requests(targets: DataFrame, page: int = 0) -> DataFrame:
    """A request for a page of each board's listing: company, ats, board, part, at, method, url, body, key. Boards of
    unknown systems, and workday boards that aren't host::tenant::site, have none."""
    sound = F.col("ats").isin(*LISTINGS) & ((F.col("ats") != "workday") | (F.size(F.split("board", "::", -1)) == 3))
    offset = {a: F.lit(str(page * (size or 0))) for a, (*_, size) in LISTINGS.items()}
    url = _by_system({a: _filled(u, offset=offset[a]) for a, (_, u, _, _) in LISTINGS.items()})
    body = _by_system({a: _filled(b, offset=offset[a]) for a, (_, _, b, _) in LISTINGS.items()})
    method = _by_system({a: F.lit(m) for a, (m, *_) in LISTINGS.items()})
    rows = targets.where(sound).select("company", "ats", "board", F.lit("list").alias("part"), F.lit(str(page)).alias("at"), method.alias("method"), url.alias("url"), body.alias("body"))
    return rows.withColumn("key", http.key_column())


def _ids(captures: DataFrame, ats: str) -> DataFrame:
    field, name = LISTED[ats]
    rows = captures.where((F.col("ats") == ats) & (F.col("part") == "list")).withColumn("page", F.col("key").try_cast("long"))
    items = F.from_json("payload", f"struct<{field}:array<struct<{name}:string>>>")[field]
    return rows.select("company", "ats", "board", "page", F.posexplode(items).alias("place", "j")).select("company", "ats", "board", "page", "place", F.col(f"j.{name}").alias("id")).where("id <> ''")


def detail_requests(captures: DataFrame, most: int = boards.DEFAULT_MOST) -> DataFrame:
    """A request for each of the first `most` postings that a board's captured listing names and doesn't describe."""
    listed = reduce(DataFrame.unionByName, [_ids(captures, a) for a in DETAILS])
    rows = first_per_board(listed, most, "page", "place").withColumn("url", _by_system({a: _filled(u, id=F.col("id")) for a, u in DETAILS.items()}))
    rows = rows.select("company", "ats", "board", F.lit("detail").alias("part"), F.col("id").alias("at"), F.lit("GET").alias("method"), "url", F.lit(None).cast("string").alias("body"))
    return rows.withColumn("key", http.key_column())


def boards_with_more(captures: DataFrame, page: int, most: int) -> DataFrame:
    """Boards whose listing goes on after this page, as far as `most` postings aren't reached."""
    j = F.from_json("payload", "struct<content:array<struct<id:string>>,jobPostings:array<struct<externalPath:string>>,total:long>")
    rows = captures.where((F.col("part") == "list") & (F.col("key") == str(page))).withColumn("j", j)
    full = (F.col("ats") == "smartrecruiters") & (F.size("j.content") >= 100) & F.lit((page + 1) * 100 < most)
    longer = (F.col("ats") == "workday") & (F.size("j.jobPostings") > 0) & (F.col("j.total") > (page + 1) * 20) & F.lit((page + 1) * 20 < most)
    return rows.where(full | longer).select("company", "ats", "board")


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The answers that a folder holds, null where it holds none."""
    try:
        return spark.read.schema(http.RESPONSE).parquet(f"{folder}/responses")
    except AnalysisException:
        return None


def ask(requests: DataFrame, folder: str, rate: float = 1.0, transport: http.Transport = http.direct, hosts_at_once: int = 6) -> DataFrame:
    """requests (with key) with status and text of their answers, from the folder or the network. What is worth
    keeping is added to the folder; a request that failed otherwise has no row, and is sent again next time."""
    spark = requests.sparkSession
    sent = http.fetch(requests.select("method", "url", "body"), stored(spark, folder), rate, hosts_at_once, transport)
    http.cacheable(sent.where("outcome <> 'cached'")).write.mode("append").parquet(f"{folder}/responses")
    return requests.join(stored(spark, folder).select("key", "status", "text").dropDuplicates(["key"]), "key")


def _captured(answers: DataFrame) -> DataFrame:
    return answers.where("status = 200 AND text <> ''").select("ats", "board", "company", "part", F.col("at").alias("key"), F.col("text").alias("payload"))


def captures(targets: DataFrame, folder: str, most: int = boards.DEFAULT_MOST, rate: float = 1.0, transport: http.Transport = http.direct) -> DataFrame:
    """Captures of all targets (company, ats, board), as boards.postings reads them. A board of an unknown system gives a
    row that says so; one that doesn't answer gives none."""
    spark, run = targets.sparkSession, uuid.uuid4().hex
    todo, page = targets.select("company", "ats", "board").distinct(), 0
    unknown = F.concat(F.lit("ValueError: unknown board system: "), "ats")
    out = todo.where(~F.col("ats").isin(*LISTINGS)).select("ats", "board", "company", F.lit("error").alias("part"), F.lit("").alias("key"), unknown.alias("payload"))

    def answered(requests: DataFrame, name: str) -> DataFrame:
        """A round's captures as a table of their own: Spark takes two states of one growing folder for the same."""
        path = f"{folder}/rounds/{run}-{name}"
        _captured(ask(requests, folder, rate, transport)).write.parquet(path)
        return spark.read.parquet(path)

    while True:
        got = answered(listing_requests(todo, page), f"list{page}")
        out = out.unionByName(got)
        todo = boards_with_more(got, page, most)
        if not todo.take(1):
            break
        page += 1
    return out.unionByName(answered(detail_requests(out, most), "detail"))
