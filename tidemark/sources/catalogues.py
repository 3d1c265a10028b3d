"""Candidate lists of catalogues, from their JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.release import name_similarity, name_tokens, normal_name

FILES = "struct<data:array<struct<attributes:struct<language:string,release:string,ratings:double,download_count:bigint,moviehash_match:boolean,ai_translated:boolean,files:array<struct<file_id:bigint,file_name:string>>>>>>"
NESTED = "struct<subtitles:array<struct<url:string,language:string,release_name:string,unpack_files:array<struct<url:string,language:string,release_name:string>>>>>"
RELEASES = "struct<data:array<struct<subtitleId:bigint,releaseInfo:array<string>,good:bigint,bad:bigint>>>"


def file_candidates(answers: DataFrame) -> DataFrame:
    """answers (request_id, ordinal, body): one candidate per file; of a file listed twice the first counts."""
    each = answers.select("request_id", "ordinal", F.posexplode(F.from_json("body", FILES)["data"]).alias("pos", "d"))
    files = each.select("request_id", "ordinal", "pos", "d.attributes", F.posexplode("d.attributes.files").alias("fpos", "f")).where("f.file_id is not null")
    first = Window.partitionBy("request_id", "f.file_id").orderBy("ordinal", "pos", "fpos")
    a = lambda c: F.col(f"attributes.{c}")
    return files.withColumn("n", F.row_number().over(first)).where("n = 1").select("request_id", F.col("f.file_id").cast("string").alias("provider_id"), a("language").alias("language"), F.coalesce(a("release"), F.col("f.file_name")).alias("release"), a("ratings").alias("rating"), a("download_count").alias("downloads"), F.coalesce(a("moviehash_match"), F.lit(False)).alias("hash_match"), F.coalesce(a("ai_translated"), F.lit(False)).alias("machine_translated"))


def nested_candidates(answers: DataFrame) -> DataFrame:
    """One candidate per unpacked file, whose own values come before its subtitle's; without such files the subtitle itself. Candidates without a url or language are left out."""
    each = answers.select("request_id", F.explode(F.from_json("body", NESTED)["subtitles"]).alias("s"))
    files = each.select("request_id", "s", F.explode_outer("s.unpack_files").alias("f"))
    own = lambda c: F.coalesce(F.nullif(F.col(f"f.{c}"), F.lit("")), F.nullif(F.col(f"s.{c}"), F.lit("")))
    return files.select("request_id", own("url").alias("provider_id"), F.lower(own("language")).alias("language"), own("release_name").alias("release")).where("provider_id is not null and language is not null")


def release_candidates(answers: DataFrame) -> DataFrame:
    """answers (request_id, filename, body): of a subtitle's release names the one most like the file's; rating: good less bad votes."""
    each = answers.select("request_id", "filename", F.explode(F.from_json("body", RELEASES)["data"]).alias("d")).where("d.subtitleId > 0")
    names = each.select("*", F.posexplode_outer("d.releaseInfo").alias("pos", "name"))
    like = F.coalesce(name_similarity(name_tokens(normal_name(F.col("filename"))), name_tokens(normal_name(F.col("name")))), F.lit(0.0))
    best = F.max_by("name", F.struct(like, -F.col("pos")))
    return names.groupBy("request_id", F.col("d.subtitleId").cast("string").alias("provider_id")).agg(best.alias("release"), F.first(F.coalesce("d.good", F.lit(0)) - F.coalesce("d.bad", F.lit(0))).cast("double").alias("rating"))
