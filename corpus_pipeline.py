"""From documents to packed training sequences: language, repeated lines, near-duplicates, benchmarks, packing.

Columns besides doc_id, text, lang and n_chars pass through every stage but the last, whatever their names.
"""

from pyspark.sql import functions as F

from strandlake.llm import common as C
from strandlake.llm.components import saved
from strandlake.llm.decontaminate import decontaminate
from strandlake.llm.language_id import fit, held_out, identify
from strandlake.llm.line_dedup import line_dedup
from strandlake.llm.near_dedup import near_dedup
from strandlake.llm.packing import pack_documents

#: A text of lower cosine with every language than this has next to nothing of any.
LEAST_SCORE = 0.05


def aside(docs, *own):
    """docs with all columns but `own` under numbered names, which clash with none of an operator's."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in own else f"_aside{i}") for i, c in enumerate(docs.columns)))


def back(found, docs, **changed):
    """The columns of docs again; changed: new values by name."""
    return found.select(*(changed[c].alias(c) if c in changed else F.col(f"_aside{i}").alias(c) for i, c in enumerate(docs.columns)))


def new_text(text):
    return {"text": text, "n_chars": F.length(text).cast("long")}


def language(spark, docs, sf_dir):
    """Keeps documents in a learned language; those without letters, or like none, go. lang becomes the predicted one.

    Null and empty texts go, as do all documents if no row has both a language and a text. Rows that repeat are each
    judged. No rows give no rows. The model is learned from texts and languages of three quarters of the doc_ids.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = aside(docs, "doc_id", "text")
    found = identify(rows, model, keep=rows.columns, lang_name="_found", score_name="_cosine").where((F.col("_found") != "und") & (F.col("_cosine") >= LEAST_SCORE))
    return back(found, docs, doc_id=F.col("doc_id"), text=F.col("text"), lang=F.col("_found"))


def lines(spark, docs, sf_dir):
    """Drops lines that many documents share, but for one of them; documents that lose lines and have nothing left go.

    Null texts become empty; they and empty ones stay, as nothing is dropped from them. Rows that repeat an id count as
    one document and each lose their lines. No rows give no rows.
    """
    rows = aside(docs, "doc_id", "text")
    kept = line_dedup(rows, extra=[c for c in rows.columns if c not in ("doc_id", "text")])
    kept = kept.where((F.col("n_dropped") == 0) | (F.trim("kept_text") != ""))
    return back(kept, docs, doc_id=F.col("doc_id"), **new_text(F.col("kept_text")))


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the least id of each group.

    Documents without an id, a text or a word stay, as they are linked with nothing. Rows that repeat an id are one
    document and all stay or go. No rows give no rows.
    """
    gone = near_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti").select(*(f"`{c}`" for c in docs.columns))


def benchmarks(spark, docs, sf_dir):
    """Cuts benchmark passages out of the texts; documents that are hit and have no word left go.

    Null and empty texts stay as they are. Rows that repeat are each cut. Without benchmark items nothing is cut; no rows
    give no rows.
    """
    rows = aside(docs, "doc_id", "text").withColumn("_whole", F.col("text"))
    found = decontaminate(rows, C.read(spark, sf_dir, "benchmark"), extra=[c for c in rows.columns if c not in ("doc_id", "text")])
    found = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return back(found, docs, doc_id=F.col("doc_id"), **new_text(F.coalesce("clean_text", "_whole")))


def packing(spark, docs, sf_dir):
    """Places of all documents, cut where need be, in sequences of the permitted lengths: the rows of pack_documents.

    A null or empty text is one place, its end. Rows that repeat are each packed; a null id stays null. Other columns are
    left out. No rows give no rows.
    """
    return pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near duplicates", near_duplicates), ("benchmarks", benchmarks), ("packing", packing)]

#: SQL can't express the learned language model, MinHash or the packing.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each on what its predecessor wrote."""
    docs, folder = C.read(spark, sf_dir, "documents"), C.shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, folder, f"stage-{k}")
    return docs
