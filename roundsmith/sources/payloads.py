"""Webhook payloads: JSON text to validated matches, rejects and round events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window, functions as F

from roundsmith.functions.scalar import is_demo, match_id_from_path, upload_name

DECLARED = ("match_id", "map_name", "rounds", "extra_data")


def _is_kind(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(kind), F.lit(False))


def parse_payloads(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw, v, match_id, map_name, error: error is null for valid payloads, else why it is refused.

    match_id and map_name must be texts, rounds (if there) a list, extra_data (if there) an object; other
    keys are kept in v and in the raw text."""
    v = F.try_parse_json(F.col(column))
    rows = raw.select(F.col(column).alias("raw"), v.alias("v"))
    text = lambda k: F.when(_is_kind(F.col("v"), f"$.{k}", "STRING"), F.try_variant_get("v", f"$.{k}", "string"))
    there = lambda k: F.try_variant_get("v", f"$.{k}", "variant").isNotNull()
    rows = rows.withColumns({"match_id": text("match_id"), "map_name": text("map_name")})
    error = (
        F.when(F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "malformed JSON")
        .when(F.col("match_id").isNull(), "match_id is missing")
        .when(F.col("map_name").isNull(), "map_name is missing")
        .when(there("rounds") & ~_is_kind(F.col("v"), "$.rounds", "ARRAY"), "rounds is no list")
        .when(there("extra_data") & ~_is_kind(F.col("v"), "$.extra_data", "OBJECT"), "extra_data is no object")
    )
    return rows.withColumn("error", error)


def accepted(parsed: DataFrame) -> DataFrame:
    """match_id, map_name, raw_data, v of valid payloads."""
    return parsed.where("error is null").select("match_id", "map_name", F.col("raw").alias("raw_data"), "v")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("raw", "error")


def extras(matches: DataFrame) -> DataFrame:
    """match_id, key, value: the undeclared top-level keys of each payload."""
    keys = F.from_json(F.col("v").cast("string"), "map<string,string>")
    return matches.select("match_id", F.explode(keys).alias("key", "value")).where(~F.col("key").isin(*DECLARED))


def payload_rounds(matches: DataFrame) -> DataFrame:
    """match_id, round_number, winner, win_type, n_events: rounds in any of the dialects, in order."""
    item = F.explode_outer(F.try_variant_get("v", "$.rounds", "array<variant>")).alias("r")
    rows = matches.select("match_id", item).where("r is not null")
    number = F.coalesce(F.try_variant_get("r", "$.round_number", "int"), F.try_variant_get("r", "$.round", "int"))
    return rows.select("match_id", number.alias("round_number"), F.try_variant_get("r", "$.winner", "string").alias("winner"), F.coalesce(F.try_variant_get("r", "$.win_type", "string"), F.try_variant_get("r", "$.reason", "string")).alias("win_type"), F.coalesce(F.size(F.try_variant_get("r", "$.events", "array<variant>")), F.lit(0)).alias("n_events"))


def payload_events(matches: DataFrame) -> DataFrame:
    """match_id, round_number, pos, time, type, actor, target, item: events whose fields go by type."""
    rounds = matches.select("match_id", F.explode(F.try_variant_get("v", "$.rounds", "array<variant>")).alias("r"))
    rows = rounds.select("match_id", F.coalesce(F.try_variant_get("r", "$.round_number", "int"), F.try_variant_get("r", "$.round", "int")).alias("round_number"), F.posexplode(F.try_variant_get("r", "$.events", "array<variant>")).alias("pos", "e"))
    get = lambda *ks: F.coalesce(*(F.try_variant_get("e", f"$.{k}", "string") for k in ks))
    return rows.select("match_id", "round_number", "pos", get("time").alias("time"), get("type").alias("type"), get("player", "killer", "planter").alias("actor"), get("target", "victim", "site").alias("target"), get("item", "weapon").alias("item"))


def demo_payload(documents: DataFrame) -> DataFrame:
    """The payload of an assembled match: its defaults, and where it comes from. documents: match_id,
    map_name, rounds, filename; matches without rounds are refused (error)."""
    return documents.select(
        F.coalesce("match_id", F.lit("upload_demo")).alias("match_id"), F.coalesce("map_name", F.lit("unknown")).alias("map_name"), "rounds",
        F.struct(F.lit("direct_upload").alias("source"), F.col("filename")).alias("extra_data"),
        F.when(F.coalesce(F.size("rounds"), F.lit(0)) <= 0, "the demo holds no rounds").alias("error"),
    )


def task_id(*parts: Column) -> Column:
    """An id in the form of a UUID, from what makes a task: a batch that is run again gives its tasks the same ids."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def enqueued(matches: DataFrame, batch_id: int) -> DataFrame:
    """Accepted matches with a task_id each. A payload that comes twice in a batch makes two tasks, told apart by
    their number among equal payloads, which does not depend on their order."""
    copy = F.row_number().over(Window.partitionBy("raw_data").orderBy("match_id"))
    return matches.select("match_id", "map_name", "raw_data", copy.alias("copy")).select(task_id(F.lit(batch_id), F.col("raw_data"), F.col("copy")).alias("task_id"), "match_id", "map_name", "raw_data")


#: What the answers to payloads and uploads say.
QUEUED, UPLOADED = "processing_in_mq", "Demo file uploaded and parsing engaged."


def acknowledged(tasks: DataFrame) -> DataFrame:
    """The answer to each payload that was taken; with temp_filename, that to an upload."""
    answer = tasks.select("task_id", "match_id", F.lit(QUEUED).alias("status"), *(["temp_filename"] if "temp_filename" in tasks.columns else []))
    return answer.withColumn("message", F.lit(UPLOADED)) if "temp_filename" in tasks.columns else answer


def uploads(files: DataFrame) -> DataFrame:
    """stored_name, match_id, error for uploaded file names (name): anything but .dem is refused."""
    ok = is_demo(F.col("name"))
    stored = files.withColumn("stored_name", F.when(ok, upload_name(F.col("name"))))
    return stored.select("name", "stored_name", match_id_from_path(F.col("stored_name")).alias("match_id"), F.when(~ok, "only .dem files are accepted").alias("error"))


def store_uploads(files: DataFrame, folder: str) -> DataFrame:
    """Stores uploaded files (name, content, and upload where equal files are uploads of their own) in a folder that all
    executors see: name, temp_filename, path, error. A stored name begins with eight digits of a hash of all three. If
    other contents stand under it, the next eight digits are taken, so no file is overwritten by another. A file is renamed when it
    is whole, so that a task that is run again leaves one file. The files are written when the result is computed. Memory holds one file at a time."""
    own = F.sha2(F.concat_ws("|", F.col("name"), F.col("upload") if "upload" in files.columns else F.lit("")).cast("binary"), 256)
    digits = F.sha2(F.concat(own.cast("binary"), F.col("content")), 256)
    kept = files.select("name", is_demo(F.col("name")).alias("ok"), digits.alias("digits"), F.element_at(F.split("name", "/"), -1).alias("base"), F.when(is_demo(F.col("name")), F.col("content")).alias("content"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)

        def put(digits: str, base: str, content: pa.Buffer) -> str:
            fs.create_dir(root, recursive=True)
            for k in range(0, len(digits), 8):
                stored = f"{digits[k : k + 8]}_{base}"
                if fs.get_file_info(f"{root}/{stored}").type == pafs.FileType.NotFound:
                    temporary = f"{root}/.{stored}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(temporary, compression=None) as f:
                        f.write(content)
                    fs.move(temporary, f"{root}/{stored}")
                    return stored
                with fs.open_input_file(f"{root}/{stored}") as f:
                    if f.size() == content.size and f.read_buffer().equals(content):
                        return stored
            raise FileExistsError(f"no free name for {base}")

        names = ["name", "temp_filename", "path", "error"]
        for b in batches:
            out = []
            for k in range(b.num_rows):
                name, ok, digits, base = (b.column(c)[k].as_py() for c in range(4))
                if not ok:
                    out.append((name, None, None, "only .dem files are accepted"))
                    continue
                try:
                    stored = put(digits, base, b.column(4)[k].as_buffer() or pa.py_buffer(b""))
                    out.append((name, stored, f"{folder}/{stored}", None))
                except OSError as e:
                    out.append((name, None, None, f"{type(e).__name__}: {e}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names)

    return kept.mapInArrow(store, "name string, temp_filename string, path string, error string")
