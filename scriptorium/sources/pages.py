"""Documents from page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import doc_manifest


def assemble_pages(pages: DataFrame, doc: str = "doc_id", order: str = "page_no",
                   text: str = "page_text") -> DataFrame:
    """Concatenate a document's pages in page order, a newline after each
    page, and count them: (doc, text, n_pages).

    One aggregate per document; a document's pages are one group, bounded
    by the document itself.
    """
    page = F.concat(F.col(text), F.lit("\n")).alias("_page")
    return (pages.select(doc, order, page).groupBy(doc)
            .agg(F.expr(f"listagg(_page, '') WITHIN GROUP (ORDER BY {order})").alias("text"),
                 F.count(F.lit(1)).alias("n_pages")))


def listed_papers(files: DataFrame, pages: DataFrame, path: str = "path", order: str = "page_no",
                  text: str = "page_text") -> DataFrame:
    """From a listing to a flow's input: the listed PDFs with the text of
    their pages: path, paper_name, stem, text (NULL without pages), n_pages.

    ``pages`` holds one row per page, keyed by the file's path."""
    texts = assemble_pages(pages, path, order, text)
    return (doc_manifest(files, path).withColumnRenamed("name", "paper_name")
            .join(texts.withColumnRenamed(path, "_path"), F.col("path") == F.col("_path"), "left")
            .select("path", "paper_name", "stem", "text", F.coalesce("n_pages", F.lit(0)).alias("n_pages")))
