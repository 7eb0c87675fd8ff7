"""Document chain: pages to blocks, memory lookup, hints, requests, results, reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.operators import attempts as a
from tmloom.operators import memory as m
from tmloom.operators import reports as rep
from tmloom.operators import segment as seg
from tmloom.operators.hints import glossary_hints
from tmloom.operators.prompts import block_prompts
from tmloom.operators.scale import global_rank, materialize, release
from tmloom.plans.parameters import DocumentParameters
from tmloom.sources import sinks
from tmloom.sources.pages import pages_with_fallback


@dataclass(frozen=True)
class DocumentRun:
    chosen: DataFrame  # pages with their text and backend
    blocks: DataFrame
    requests: DataFrame
    attempts: DataFrame
    results: DataFrame  # cache hits and fresh results
    new_memory: DataFrame  # entries to append to the memory log


def plan_requests(
    misses: DataFrame, memory: DataFrame, params: DocumentParameters = DocumentParameters()
) -> DataFrame:
    """Prompts for the blocks the memory does not answer, with glossary hints."""
    return requests_with(misses, m.term_frequencies(memory), params)


def requests_with(
    misses: DataFrame, terms: DataFrame, params: DocumentParameters, stored: bool = False
) -> DataFrame:
    hints = glossary_hints(misses, terms, params.hints_per_block, stored=stored)
    return block_prompts(misses, hints, params.system).withColumns(
        {
            "request_id": F.concat_ws("/", "doc_key", "block_id"),
            "payload": F.to_json(F.struct("system_text", "user_text")),
        }
    )


def _waves(misses: DataFrame, waves: int) -> DataFrame:
    """``misses`` with ``_wave``: each document's pages in order, cut into ``waves`` parts."""
    spans = misses.groupBy("doc_key").agg(F.min("page").alias("_first"), F.max("page").alias("_last"))
    share = (F.col("page") - F.col("_first")) / (F.col("_last") - F.col("_first") + 1)
    return misses.join(spans, "doc_key").withColumn("_wave", F.floor(share * waves).cast("int")).drop("_first", "_last")


def _terms_of(results: DataFrame, wave: int) -> DataFrame:
    """The terms of a wave's new results, of each text the last one's, seen after those of all earlier waves."""
    ok = results.where(F.col("status") == "ok")
    place = F.struct("page", "block_no")
    last = ok.groupBy("doc_key", "source_text").agg(
        F.max_by("term_pairs", place).alias("pairs"), F.min(place).alias("place")
    )
    return (
        last.select("doc_key", "place", F.posexplode("pairs").alias("pos", "pair"))
        .groupBy("doc_key", "pair.source", "pair.target")
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            F.min(F.struct(F.lit(wave).alias("wave"), F.col("place.page").cast("long").alias("page"), "place.block_no", "pos")).alias("first_seen"),
        )
    )


def _in_waves(terms: DataFrame) -> DataFrame:
    """The memory's terms, in their order, before those of any wave."""
    ranked = global_rank(
        terms.withColumn("_seen", F.struct("first_seen", "source", "target")), "_seen", "_rank", ["doc_key"]
    )
    place = F.struct(
        F.lit(0).alias("wave"), F.col("_rank").alias("page"), F.lit(0).alias("block_no"), F.lit(0).alias("pos")
    )
    return ranked.withColumn("first_seen", place).drop("_seen", "_rank")


def translate_documents(
    pages: DataFrame,
    memory: DataFrame,
    caller: a.Caller,
    params: DocumentParameters = DocumentParameters(),
    waves: int = 1,
) -> DocumentRun:
    """Translate pages block by block, with the memory's answers and terms.

    With several ``waves`` a document's pages are sent in as many parts, in
    order; the terms that come back with one part are hints for the next, so
    hints grow inside a run.
    """
    chosen = pages_with_fallback(pages)
    # Cleaning and chunking is the costly narrow step; several joins read it.
    blocks = materialize(
        seg.limit_blocks(seg.blocks_of(chosen, params.max_chars), params.limit_blocks), "blocks"
    )
    hits, misses = m.lookup_exact(blocks, memory)
    terms = m.term_frequencies(memory)
    if waves > 1:
        misses = materialize(_waves(misses, waves), "misses")
        terms = materialize(_in_waves(terms), "terms")
    sent = []
    for wave in range(waves):
        part = misses.where(F.col("_wave") == wave).drop("_wave") if waves > 1 else misses
        requests, tried = a.run_waves(
            requests_with(part, terms, params, stored=waves > 1),
            caller,
            a.block_judge,
            params.max_attempts,
            delay=a.document_delay(
                params.retry_base_delay,
                rate_limit_cap=params.rate_limit_cap,
                error_cap=params.error_cap,
            ),
            judge_by=(),
        )
        resolved = a.resolve_attempts(tried, params.max_attempts, ["translation", "term_pairs"])
        fresh = a.fill_failed_blocks(requests, resolved, params.max_attempts)
        if wave < waves - 1:
            fresh = materialize(fresh, "fresh")
            before, terms = terms, materialize(
                terms.unionByName(_terms_of(fresh, wave + 1)).groupBy("doc_key", "source", "target").agg(
                    F.sum("frequency").alias("frequency"), F.min("first_seen").alias("first_seen")
                ), "terms",
            )
            release(before)
        sent.append((requests, tried, fresh))
    requests, tried, fresh = (reduce(DataFrame.unionByName, x) for x in zip(*sent))
    results = materialize(m.combine_results(hits, fresh), "results")
    return DocumentRun(
        chosen, blocks, requests, tried, results, m.upsert_memory(memory, results)
    )


def write_artifacts(
    run: DocumentRun, path: str, params: DocumentParameters = DocumentParameters()
) -> dict[str, str]:
    """Tables, document, review, raw results and manifest under ``path``."""
    skipped = seg.skipped_page_lists(run.chosen)
    paths = sinks.write_tables(
        rep.extraction_view(run.blocks, skipped),
        rep.bilingual_view(rep.order_results(run.results)),
        rep.glossary_view(rep.glossary(run.results)),
        path,
    )
    for name, write, df in (
        ("document", sinks.write_document, rep.assemble_document(run.results)),
        ("review", sinks.write_review, rep.review_report(run.results)),
        ("results", sinks.write_results_json, rep.order_results(run.results)),
    ):
        paths[name] = f"{path}/{name}"
        write(df, paths[name])
    manifest = rep.run_manifest(run.blocks, run.results, run.chosen, params.to_json(), paths)
    sinks.write_manifest(manifest, f"{path}/run_manifest")
    return {**paths, "manifest": f"{path}/run_manifest"}
