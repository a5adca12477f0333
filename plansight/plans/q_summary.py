"""Corpus summary per repo."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import ordered as O
from ..sources import corpus as S
from .catalog import query
from .q_corpus import CL, INV_DUCK


def _paths(files, name, n):
    """(repo, name, n_name): the paths joined in order, the first ``n`` if given, and how many there are."""
    counts = files.groupBy("repo").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    shown = files if n is None else O.top_n(files, ["repo"], ["path"], n).drop("rank")
    return shown.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias(name)).join(counts, "repo")


def repo_summary(files, entities, readme_chars=None, routes=None, key_files=None):
    """README, package name and description, detected entities, API
    route files and key files (path order), with the number of each.

    Limits for a prompt of bounded length are parameters (the README gets an
    ellipsis when it is cut); by default nothing is cut."""
    p = F.col("path")
    text = F.col("content") if readme_chars is None else F.concat(
        F.substring("content", 1, readme_chars), F.when(F.length("content") > readme_chars, F.lit("...")).otherwise(F.lit("")))
    readme = O.top_n(files.where(F.lower(p).contains("readme")), ["repo"], ["path"], 1, "_r") \
        .select("repo", text.alias("readme"), F.length("content").alias("readme_chars"))
    pkg = files.where(p == "package.json").select(
        "repo", F.get_json_object("content", "$.name").alias("project_name"),
        F.get_json_object("content", "$.description").alias("project_description"))
    api = _paths(files.where(p.contains("/api/") | p.contains("/routes/")).select("repo", "path"), "api_routes", routes)
    key = files.where(~p.contains("node_modules") & ~p.contains(".git")
                      & (p.contains("/types/") | p.contains("/models/") | p.contains("/components/") | p.contains("/pages/")))
    key = _paths(key.select("repo", "path"), "key_files", key_files)
    ents = entities.groupBy("repo").agg(F.count(F.lit(1)).alias("n_entities"))
    repos = files.select("repo").distinct()
    return (repos.join(readme, "repo", "left").join(pkg, "repo", "left").join(ents, "repo", "left")
            .join(api, "repo", "left").join(key, "repo", "left"))


@query("repo_summary", oracle=INV_DUCK.rstrip() + """,
files AS (SELECT repo, path, string_agg(text, chr(10) ORDER BY line_no) AS content FROM code_lines GROUP BY repo, path),
ents AS (SELECT repo, count(DISTINCT string_split(name, '_')[1]) AS n_entities FROM calls
         WHERE length(string_split(name, '_')[1]) >= 3 GROUP BY repo),
api AS (SELECT repo, string_agg(path, ', ' ORDER BY path) AS api_routes, count(*) AS n_api_routes FROM files
        WHERE contains(path, '/api/') OR contains(path, '/routes/') GROUP BY repo),
kf AS (SELECT repo, string_agg(path, ', ' ORDER BY path) AS key_files, count(*) AS n_key_files FROM files
       WHERE NOT contains(path, 'node_modules') AND NOT contains(path, '.git')
         AND (contains(path, '/types/') OR contains(path, '/models/') OR contains(path, '/components/') OR contains(path, '/pages/'))
       GROUP BY repo),
rd AS (SELECT repo, arg_min(content, path) AS readme, arg_min(length(content), path) AS readme_chars
       FROM files WHERE contains(lower(path), 'readme') GROUP BY repo),
pk AS (SELECT repo, json_extract_string(content, '$.name') AS project_name,
              json_extract_string(content, '$.description') AS project_description FROM files WHERE path = 'package.json')
SELECT r.repo, rd.readme, rd.readme_chars, pk.project_name, pk.project_description, ents.n_entities,
       api.api_routes, api.n_api_routes, kf.key_files, kf.n_key_files
FROM (SELECT DISTINCT repo FROM files) r LEFT JOIN rd USING (repo) LEFT JOIN pk USING (repo) LEFT JOIN ents USING (repo)
LEFT JOIN api USING (repo) LEFT JOIN kf USING (repo)""")
def q_repo_summary(spark, sf_dir):
    _, files = S.corpus_tables(spark, sf_dir)
    ents = K.inventory_entities(K.inventory_calls(files))
    return repo_summary(files, ents)
