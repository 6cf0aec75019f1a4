"""Which files are taken: the first rule that a file breaks names its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TYPES = {"pdf": ["application/pdf"], "jpg": ["image/jpeg", "image/jpg"], "jpeg": ["image/jpeg", "image/jpg"], "png": ["image/png"]}
MOST_BYTES, MOST_PAGES = 10 * 1024 * 1024, 3


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def admit(files: DataFrame) -> DataFrame:
    """files(file_name, content_type, length, page_count) with ext, file_type, is_supported, is_readable, status,
    error_code, error_message.

    page_count may be null while a file is not yet decoded; then its rule waits. files may have decode_error,
    what a reader said of a damaged file. is_readable: true once pages are counted, false if the reader
    failed, else null. Size and name are checked before anything reads the content. A null content_type
    counts as empty.
    """
    mimes = sorted({m for v in TYPES.values() for m in v})
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    broken = F.col("decode_error") if "decode_error" in files.columns else F.lit(None).cast("string")
    x = files.withColumn("ext", extension(F.col("file_name")))
    known = F.col("ext").isin(*TYPES)
    fits = F.lit(False)
    for ext, allowed in TYPES.items():
        fits = fits | ((F.col("ext") == ext) & kind.isin(*allowed))
    message = (
        F.when(~known, F.concat(F.lit("Unsupported file type; allowed: "), F.lit(", ".join(sorted(TYPES)))))
        .when((kind != "") & ~kind.isin(*mimes), "Content type is not allowed")
        .when((kind != "") & ~fits, "Content type does not match the extension")
        .when(F.coalesce("length", F.lit(0)) == 0, "File is empty")
        .when(F.col("length") > MOST_BYTES, "File is larger than 10 MB")
        .when(broken.isNotNull(), F.concat(F.lit("File is damaged or cannot be read: "), broken))
        .when(~F.col("page_count").between(1, MOST_PAGES), F.lit(f"File must have 1 to {MOST_PAGES} pages"))
    )
    x = x.withColumn("error_message", message)
    return x.withColumns({
        "file_type": F.when(kind != "", F.col("content_type")).otherwise(F.concat(F.lit("application/"), F.col("ext"))),
        "is_supported": known,
        "is_readable": F.when(broken.isNotNull(), False).when(F.col("page_count").isNotNull(), True),
        "status": F.when(F.col("error_message").isNull(), "PASS").otherwise("FAILED"),
        "error_code": F.when(F.col("error_message").isNotNull(), F.when(known, "INVALID_FILE_ERROR").otherwise("UNSUPPORTED_FILE_TYPE")),
    })
