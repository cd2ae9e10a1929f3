"""Reports, mentions, evaluation rounds and checks out of shredded payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.shredding import bridge, int_of, objects, occurrences, text_of
from loomtext.workspace import Workspace


def _get(name: str, of: str = "scalars") -> Column:
    return F.try_element_at(of, F.lit(name))


def _there(name: str) -> Column:
    return F.coalesce(_get(name) != "null", F.lit(False))


class ReportTables:
    """Flat tables of df (file_id, payload, received_at); the payloads are parsed once.

    A record is an object with a `text`, a number under `report_number` or else `id`, and a
    `revision` or `mentions`. Of a report's records that with the highest revision counts, among
    equal ones the last received, then the greater file_id and hash. Payloads that are no valid
    JSON, blank or without a record give no rows; extra columns of df are ignored.
    """

    def __init__(self, df: DataFrame):
        work = Workspace(df.sparkSession, "reports")
        self.occurrences = work.keep(occurrences(df, "payload", {"file_id": F.col("file_id"), "received_at": F.col("received_at")}), "occurrences")
        self.objects = objects(self.occurrences, work)
        number = F.coalesce(int_of(_get("report_number")), int_of(_get("id")))
        keys = F.map_keys("scalars")
        is_record = number.isNotNull() & F.array_contains(keys, "text") & (F.array_contains(keys, "revision") | F.array_contains(keys, "mentions") | F.exists("children", lambda c: c["field"] == "mentions"))
        held = work.keep(self.objects.where(is_record).select("hash", number.alias("report_number"), int_of(_get("revision")).alias("revision"), F.coalesce(text_of(_get("text")), F.lit("")).alias("text"), "children"), "records")
        files = self.occurrences.select("hash", "received_at", "file_id").join(held.select("hash", "report_number", "revision"), "hash")
        best = files.groupBy("report_number").agg(F.max(F.struct("revision", "received_at", "file_id", "hash")).alias("o")).select("report_number", "o.*")
        #: (report_number, revision, received_at, file_id, hash, text, children)
        self.reports = work.keep(best.join(held.select("hash", "text", "children"), "hash"), "reports")

    def bridge(self) -> DataFrame:
        return bridge(self.objects)

    def _parts(self, rows: DataFrame, field: str | None, *keep: str, place: str = "ordinal") -> DataFrame:
        """(keep..., field, place, hash): objects linked to by rows (keep..., children)."""
        held = rows.select(*keep, F.explode("children").alias("c")).where("c.hash is not null")
        held = held if field is None else held.where(F.col("c.field") == field)
        return held.select(*keep, F.col("c.field").alias("field"), F.col("c.ordinal").alias(place), F.col("c.hash").alias("hash"))

    def _below(self, rows: DataFrame, field: str, *keep: str) -> DataFrame:
        """(keep..., children) of the objects in a field of rows (keep..., children)."""
        return self._parts(rows, field, *keep).select(*keep, "hash").join(self.objects.where(F.size("children") > 0).select("hash", "children"), "hash").select(*keep, "children")

    def mentions(self) -> DataFrame:
        """(report_number, attribute, pos, mention, start, length, located, agrees): one row per mention object.

        located: start and length are both present. agrees: that many code points of the text
        from start are exactly the mention; false for places outside the text or unreadable ones.
        """
        each = self._parts(self._below(self.reports, "mentions", "report_number"), None, "report_number", place="pos").withColumnRenamed("field", "attribute")
        # only what a mention needs of an object meets the mentions
        content = self.objects.select("hash", text_of(_get("mention")).alias("mention"), int_of(_get("start")).alias("start"), int_of(_get("length")).alias("length"), (_there("start") & _there("length")).alias("located"))
        one = each.join(content, "hash").select("report_number", F.struct("attribute", "pos", "mention", "start", "length", "located").alias("m"))
        # the text meets its mentions once, not once per mention
        grouped = one.groupBy("report_number").agg(F.collect_list("m").alias("ms")).join(self.reports.select("report_number", "text"), "report_number")

        def judged(m: Column) -> Column:
            fits = (m["start"] >= 0) & (m["length"] >= 0) & (m["start"] + m["length"] <= F.length("text"))
            span = F.substring(F.col("text"), m["start"].cast("int") + 1, m["length"].cast("int"))
            return m.withField("agrees", F.coalesce(F.when(fits, span == m["mention"]), F.lit(False)))

        return grouped.select("report_number", F.explode(F.transform("ms", judged)).alias("m")).select("report_number", "m.*")

    def _rounds(self) -> DataFrame:
        """(report_number, round, hash)"""
        return self._parts(self._below(self.reports, "evaluation", "report_number"), "rounds", "report_number", place="round")

    def rounds(self) -> DataFrame:
        """(report_number, round, annotator): evaluation rounds in their order."""
        return self._rounds().join(self.objects.select("hash", text_of(_get("annotator")).alias("annotator")), "hash").select("report_number", "round", "annotator")

    def checks(self) -> DataFrame:
        """(report_number, round, check, attribute, ok, hits): checks of a round in their order, hits as JSON."""
        held = self._rounds().select("report_number", "round", "hash").join(self.objects.where(F.size("children") > 0).select("hash", "children"), "hash")
        content = self.objects.select("hash", text_of(_get("attr")).alias("attribute"), (_get("ok") == "true").alias("ok"), _get("hits").alias("hits"))
        return self._parts(held, "checks", "report_number", "round", place="check").join(content, "hash").select("report_number", "round", "check", "attribute", "ok", "hits")
