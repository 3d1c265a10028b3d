"""The same adapter SQL for Spark and for the SQL that checks it: only what the two spell differently."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    folder: str | None = None  # of the tables, for Spark; None for the checking engine, where they are views

    def table(self, name: str) -> str:
        return f"parquet.`{self.folder}/{name}.parquet`" if self.folder else name

    def at(self, values: str, number: str) -> str:
        """The number-th (from 1) of comma-separated values."""
        return f"element_at(split('{values}', ','), CAST({number} AS INT))" if self.folder else f"(string_split('{values}', ','))[{number}]"

    def each(self, first: str, last: str) -> str:
        return f"explode(sequence({first}, {last}))" if self.folder else f"unnest(generate_series({first}, {last}))"

    def millis(self, column: str) -> str:
        return f"CAST(floor({f'unix_micros(CAST({column} AS TIMESTAMP))' if self.folder else f'epoch_us({column})'} / 1000.0) AS BIGINT)"

    def words(self, column: str) -> str:
        return f"size(split({column}, ' '))" if self.folder else f"len(string_split({column}, ' '))"


def requests(d: Dialect) -> str:
    """A media request for each part."""
    return f"""SELECT p_partkey AS request_id, 'Title' || CAST(p_partkey % 97 AS STRING) || '.' || CAST(1990 + p_partkey % 35 AS STRING)
      || CASE WHEN p_size % 4 = 0 THEN '.S0' || CAST(1 + p_size % 3 AS STRING) || 'E0' || CAST(1 + p_size % 5 AS STRING) ELSE '' END
      || CASE WHEN p_size % 6 = 0 THEN '.Extended' ELSE '' END || '.1080p.' || {d.at("BluRay,WEB-DL,HDTV,DVDRip,BDRemux", "1 + p_size % 5")} || '.x264-GRP' || CAST(p_partkey % 7 AS STRING) || '.mkv' AS filename,
      CASE WHEN p_size % 4 = 0 THEN 1 + p_size % 3 END AS season, CASE WHEN p_size % 4 = 0 THEN 1 + p_size % 5 END AS episode FROM {d.table("part")}"""


def candidates(d: Dialect) -> str:
    """The candidates that catalogues offer for each request: one per line item."""
    return f"""SELECT l_partkey AS request_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS ordinal,
      'catalogue' || CAST(l_suppkey % 3 AS STRING) AS provider, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS provider_id,
      CASE WHEN l_linenumber = 7 THEN NULL ELSE 'Title' || CAST(l_partkey % 97 AS STRING) || '.' || CAST(1990 + (l_partkey + l_linenumber % 2) % 35 AS STRING)
      || CASE WHEN l_linenumber = 3 THEN '.S01E0' || CAST(1 + l_suppkey % 5 AS STRING) ELSE '' END || CASE WHEN l_linenumber = 4 THEN '.Extended' ELSE '' END || '.'
      || {d.at("BluRay,WEB-DL,HDTV,DVDRip,remux", "1 + l_suppkey % 5")} || CASE WHEN l_linenumber = 5 THEN '.25fps' ELSE '.x264' END || '-GRP' || CAST(l_orderkey % 7 AS STRING) END AS release,
      l_orderkey % 50 = 0 AS hash_match, l_linenumber = 6 AS machine_translated, CAST(l_quantity - 10 AS DOUBLE) AS rating, CAST(floor(l_extendedprice) AS BIGINT) AS downloads FROM {d.table("lineitem")}"""


def runs(d: Dialect) -> str:
    """A run of the service for each order."""
    return f"""SELECT o_orderkey AS run_id, {d.millis("o_orderdate")} AS at_ms, o_custkey AS content_id,
      CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'direct' END WHEN o_orderstatus = 'O' THEN 'cached' ELSE 'translated' END AS outcome,
      CAST(floor(o_totalprice) AS BIGINT) AS total_ms, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 AND o_orderkey % 5 > 0 THEN o_orderpriority END AS failure,
      CASE WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 4 > 0 THEN o_orderkey % 1400 END AS cues, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 5 END AS transcripts FROM {d.table("orders")}"""


def visits(d: Dialect) -> str:
    """What clients did, in time divided by 3,600 (the events are sparse)."""
    return f"""SELECT user_id AS client, event_id, event_type AS kind, CAST(floor({d.millis("ts")} / 3600.0) AS BIGINT) AS at_ms, CAST(floor(value) AS BIGINT) % 40 AS item FROM {d.table("events")}"""


def cue_times(d: Dialect) -> str:
    """Cues of a text: one for every six words, at planted times."""
    return f"""SELECT track_id, k, CAST(sum(1500 + (k * 1777) % 4300) OVER (PARTITION BY track_id ORDER BY k) AS BIGINT) AS start_ms, 700 + (k * 613) % 1400 AS length_ms
      FROM (SELECT track_id, CAST(n - 1 AS BIGINT) AS k FROM (SELECT doc_id AS track_id, {d.each("1", f"CAST(floor({d.words('text')} / 6.0) AS BIGINT)")} AS n FROM {d.table("documents")} WHERE {d.words("text")} >= 6) s) t"""
