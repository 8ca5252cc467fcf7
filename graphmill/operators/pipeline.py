"""Whole jobs: a corpus prepared, mended or translated, systems evaluated and compared, statistics of tokenizers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import graphs as G
from ..functions import text as X
from ..session import cut
from ..sources import corpus, sinks
from . import scoring
from .prepare import first_of_sentence, rows_of_assigned


def prepare_dataset(spark: SparkSession, roots: list[str], langs: list[str], *, dedupe: bool = False, remove_wiki: bool = False, fix_text: bool = False, normalize_punct: bool = False, detokenize: bool = False, remove_bracketed: bool = False, split_across_languages: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows before deduplication, prepared rows) of corpora, one root a language: metadata, sentence, penmanstr, split_type, src_lang_idx.

    Blocks that can't be decoded, or lack an id or sentence, stop the job and name their file.
    """
    if len(roots) != len(langs):
        raise ValueError("as many languages as corpora are needed")
    rows = corpus.read_corpus(spark, roots[0], 0, strict=True)
    for i, root in enumerate(roots[1:], 1):
        rows = rows.unionByName(corpus.read_corpus(spark, root, i, strict=True))
    rows = rows.withColumn("row_id", F.xxhash64("file", "block_no")).withColumn("id", F.element_at("metadata", "id"))
    if split_across_languages:
        rows = rows_of_assigned(rows, len(langs))
    lang = F.element_at(F.array(*map(F.lit, langs)), F.col("src_lang_idx") + 1)
    sentence = F.col("sentence")
    for wanted, step in ((fix_text, X.fix_text), (normalize_punct, lambda c: X.normalize_punctuation(c, lang)), (detokenize, lambda c: X.detokenize(c, lang))):
        if wanted:
            sentence = step(sentence)
    graph = G.encode_graph(G.without_wiki(G.decode_graph("penmanstr")["triples"])) if remove_wiki else F.col("penmanstr")
    rows = cut(rows.withColumn("sentence", sentence).withColumn("penmanstr", X.dash_to_hyphen(graph)))
    if remove_bracketed:
        rows = rows.filter(~X.punct_wrapped(F.col("sentence")))
    ready = rows.withColumn("s", F.col("sentence"))
    # scan order: language, split, file, block
    ready = first_of_sentence(ready) if dedupe else ready
    return rows, ready.select("metadata", "sentence", "penmanstr", F.col("split").alias("split_type"), "src_lang_idx", "split", "id")


def write_dataset(before: DataFrame, ready: DataFrame, out: str, options: dict) -> None:
    """Parquet and JSON by split, the options with sizes, and the kept ids as a table by split."""
    sinks.write_splits(ready, f"{out}/dataset")
    sinks.write_splits(ready, f"{out}/json", as_json=True)
    sinks.write_document(sinks.processing_info(before, ready, options), f"{out}/info")
    ready.select("split", "id").distinct().write.mode("overwrite").partitionBy("split").parquet(f"{out}/kept_ids")


def fix_corpus(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line: sentence lines in one form (entities, quotation marks, blanks), all other lines as they are."""
    lines = corpus.read_lines(spark, path)
    return lines.withColumn("line", F.when(F.col("line").startswith("# ::snt "), X.collapse_blanks(X.fix_text(F.col("line")))).otherwise(F.col("line")))


def write_lines(lines: DataFrame, out: str) -> None:
    """The lines of each file as one row of a table: file, text; a file is as large as it was when read."""
    texts = lines.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    texts.write.mode("overwrite").parquet(out)


def _in_batches(values: pd.Series, size: int, f: Callable[[list[str]], Iterable[str]]) -> list[str]:
    out: list[str] = []
    for at in range(0, len(values), size):
        out += list(f(values.iloc[at : at + size].tolist()))
    return out


def translate_corpus(lines: DataFrame, translate: Callable[[list[str]], Iterable[str]], batch: int = 32) -> DataFrame:
    """Sentence lines replaced by what ``translate`` makes of their sentences, in batches within each task; no shuffle."""

    def run(pdfs):
        for pdf in pdfs:
            mine = pdf["line"].str.startswith("# ::snt ")
            if mine.any():
                texts = pdf.loc[mine, "line"].str[len("# ::snt ") :]
                pdf.loc[mine, "line"] = ["# ::snt " + " ".join(t.split()) for t in _in_batches(texts, batch, translate)]
            yield pdf

    return lines.select("file", "line_no", "line").mapInPandas(run, "file string, line_no int, line string")


def infer(rows: DataFrame, key: str, sentence: str, generate: Callable[[list[str]], Iterable[list[tuple[str, float]]]], batch: int = 8) -> DataFrame:
    """sample_id, beam_idx, graph, status, score of the candidates that ``generate`` gives for each sentence."""

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                for k, beams in zip(part[key].tolist(), generate(part[sentence].tolist())):
                    out += [(k, i, g, s) for i, (g, s) in enumerate(beams)]
            yield pd.DataFrame(out, columns=["sample_id", "beam_idx", "text", "score"])

    beams = rows.select(key, sentence).mapInPandas(run, "sample_id long, beam_idx int, text string, score double")
    decoded = beams.withColumn("r", G.decode_any("text"))
    status = F.when(F.col("r.status") == "ok", 0).when(F.col("r.status") == "fixed", 1).otherwise(2)
    return decoded.select("sample_id", "beam_idx", G.encode_graph("r.triples").alias("graph"), status.alias("status"), "score")


def evaluate(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts of each pair, scores of each system with intervals). predictions: system, uid, penman_str, reference_penman_str."""
    pairs = predictions.filter("reference_penman_str is not null").select("system", "uid", G.match_graphs("penman_str", "reference_penman_str").alias("m"))
    pairs = cut(pairs.select("system", "uid", "m.*"))
    return pairs, scoring.intervals(pairs)


def rescore(predictions: DataFrame) -> DataFrame:
    """system, status, n: statuses, with those that could not be scored as backoff."""
    back = G.match_graphs("penman_str", "reference_penman_str")["backed_off"]
    return predictions.select("system", F.when(back, "backoff").otherwise(F.coalesce("status", F.lit("none"))).alias("status")).groupBy("system", "status").agg(F.count(F.lit(1)).alias("n"))


#: Lengths that need no model: characters, words, bytes.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"chars": F.length, "words": X.word_count, "bytes": F.octet_length}


def corpus_statistics(rows: DataFrame, tokenizers: dict[str, Callable[[Column], Column]] | None = None, most: int = 1024) -> DataFrame:
    """tokenizer, split, n, longest and 95th and 99th percentile of sentences and graphs, and how many are beyond ``most``.

    From counts of lengths, so a group is as large as the lengths that occur in it. rows: split, sentence, penmanstr.
    """
    lengths = F.array(*(F.struct(F.lit(k).alias("tokenizer"), f(F.col("sentence")).cast("long").alias("sent"), f(F.col("penmanstr")).cast("long").alias("label")) for k, f in (tokenizers or TOKENIZERS).items()))
    long = rows.select("split", F.explode(lengths).alias("x")).select("split", "x.tokenizer", F.explode(F.array(F.struct(F.lit("sentence").alias("field"), F.col("x.sent").alias("len")), F.struct(F.lit("label").alias("field"), F.col("x.label").alias("len")))).alias("y"))
    counts = long.select("split", "tokenizer", "y.*").filter("len is not null").groupBy("split", "tokenizer", "field", "len").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("len", F.array(F.lit(0.95), F.lit(0.99)), F.col("n"))
    out = counts.groupBy("tokenizer", "split", "field").agg(F.sum("n").alias("n"), F.max("len").alias("longest"), q.alias("q"), F.sum(F.when(F.col("len") > most, F.col("n")).otherwise(0)).alias("beyond"))
    return out.select("tokenizer", "split", "field", "n", "longest", F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"), "beyond")
