"""What a provider embeds as it is, without a text: images and audio whole, PDF files by their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources import pdf

#: Image formats that providers don't read, and nothing here converts.
CONVERTED = (".heic", ".heif")
KINDS = ("image", "audio")


def embedded(kind: Column, extension: Column) -> Column:
    """Whether a file of a kind is embedded as it is."""
    return F.coalesce((kind.isin(*KINDS) & ~extension.isin(*CONVERTED)) | (extension == ".pdf"), F.lit(False))


def parts(files: DataFrame, content: str = "content", size: int = pdf.PAGES, overlap: int = pdf.OVERLAP) -> DataFrame:
    """A row for each part of files (file_id, extension, media_type, content): file_id, chunk_index from 0, media_type, page_start, page_end, content.

    PDF files are parts of size pages, of which overlap are the part before's too; other files are one part without pages. Null and empty contents
    have no part. Repeated rows give repeated parts; other columns are ignored.
    """
    some = files.filter(F.octet_length(content) > 0).select("file_id", "extension", "media_type", F.col(content).alias("content"))
    is_pdf = F.col("extension").eqNullSafe(".pdf")
    pages = pdf.parts(some.filter(is_pdf), ["file_id", "media_type"], size=size, overlap=overlap)
    none = F.lit(None).cast("int")
    whole = some.filter(~is_pdf).select("file_id", "media_type", F.lit(0).alias("chunk_index"), none.alias("page_start"), none.alias("page_end"), "content")
    return whole.unionByName(pages).select("file_id", "chunk_index", "media_type", "page_start", "page_end", "content")
