"""Language identification by Bayesian fusion of evidence.

log P(lang | page) is, up to a constant, the sum of

* the text's log likelihood: naive Bayes over hashed words and byte trigrams, fitted on a bounded sample of labelled documents
  (``SAMPLE`` of each language, by least hash of the id), tempered by ``TEMPER`` and per feature, as neighbouring features are not independent;
* the declared markup language (``lang`` of the html element): right with probability ``DECLARED``, else uniform;
* the address: a language code as the first or last label of the host or first part of the path, right with probability ``ADDRESS``;
* a prior of the host, hierarchically smoothed: global counts smooth those of the suffix, these those of the
  registered name, these those of the host, each with ``STRENGTH`` pseudo-counts of the level above.

The counts of the priors are the posteriors by text and markup of all pages, summed by grouped aggregation; sums are made per host
first, and the levels above from these, so a host with a third of all pages is pre-aggregated before it is shuffled. A page's own posterior is
taken out of its host's counts.

Null and empty HTML: the text says nothing, the other evidence decides; a null url has the empty host. Ties go to the language that is first by
name. No labelled documents: no languages, so lang is null. Repeated pages are each identified, and each count for their host; no pages, no rows. All languages
of the labelled documents are taken; only the named columns are read, whatever else there is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moderix.llm import stages, textvec

#: Most labelled documents of each language that the fit takes.
SAMPLE = 300
#: Sampled ids that are broadcast, at most: about 3 MB. More, of very many languages, are joined by key.
BROADCAST = 100_000
BUCKETS = 1 << 16
TEMPER, DECLARED, ADDRESS, STRENGTH = 0.2, 0.9, 0.8, 5.0
OPEN = re.compile(r"(?i)<(?:(script|style|template|noscript)\b|!--)?")
CLOSE = {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "template", "noscript")} | {None: re.compile("-->")}


def visible(html: str | None) -> str:
    """The text between the tags, without scripts, styles, templates and comments, in time linear in the page's length: an end that
    was not found once is not looked for again."""
    import html as entities

    page, out, at, absent = html or "", [], 0, set()
    while (m := OPEN.search(page, at)) and "<" not in absent:
        name = m[1].lower() if m[1] else None
        to = None
        if (name or len(m[0]) > 1) and name not in absent:
            if (end := CLOSE[name].search(page, m.end())) is None:
                absent.add(name)
            else:
                to = end.end()
        if to is None and (to := page.find(">", m.start()) + 1) == 0:
            absent.add("<")
            break
        out += [page[at : m.start()], " "]
        at = to
    return entities.unescape("".join([*out, page[at:]]))


def bucket_features(texts: pa.Array) -> Iterator[tuple[textvec.Words, np.ndarray, np.ndarray]]:
    """(piece, document, bucket) of the words and of the byte trigrams within words."""
    for w in textvec.pieces(texts, textvec.LETTERS, latin=True):
        n = w.end - w.start
        tri = np.maximum(n - 2, 0)
        start = np.repeat(w.start, tri) + np.arange(tri.sum()) - np.repeat(np.cumsum(tri) - tri, tri)
        grams = w.part_hash(start, start + 3)
        yield w, np.concatenate([w.doc, np.repeat(w.doc, tri)]), (np.concatenate([w.hash ^ np.uint64(77), grams]) >> np.uint64(48)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # [language, bucket]

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Tempered log likelihoods [text, language]; 0 for a text without features."""
        out = np.zeros((len(texts), len(self.languages)))
        for w, doc, bucket in bucket_features(texts):
            docs = len(w.doc_start) - 1
            for k in range(len(self.languages)):
                out[w.docs, k] = TEMPER * np.bincount(doc, weights=self.log_p[k, bucket], minlength=docs)
        return out


def fit(texts: pa.Array, langs: list[str]) -> TextModel:
    names = sorted(set(langs))
    code = np.array([names.index(x) for x in langs], np.int64)
    counts = np.zeros((len(names), BUCKETS))
    for w, doc, bucket in bucket_features(texts):
        np.add.at(counts, (code[doc + w.docs.start], bucket), 1)
    counts += 0.1
    return TextModel(names, np.log(counts / counts.sum(axis=1, keepdims=True)))


def trained(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """A text model from (doc_id, text, lang), of all languages; the sample is taken in one pass."""
    known = docs.select(F.col("doc_id").alias("id"), "lang").filter("id is not null and lang is not null").distinct()
    # the greatest hash that is taken, by language: counts by range of hashes tell where the sample ends, so no language is sorted in one task
    place = F.shiftrightunsigned(F.xxhash64("id"), 52)
    counts = known.groupBy("lang", place.alias("at")).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = counts.withColumn("before", before).filter(F.col("before") < sample).select("lang", "at", "before")
    near = known.withColumn("at", place).join(taken, ["lang", "at"])
    rank = F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.xxhash64("id"), "id")) + F.col("before")
    picked = stages.written(near.withColumn("rank", rank).filter(F.col("rank") <= sample).select("id", "lang"), "sample")
    picked = F.broadcast(picked) if picked.count() <= BROADCAST else picked
    rows = docs.select(F.col("doc_id").alias("id"), "lang", F.coalesce("text", F.lit("")).alias("text")).join(picked, ["id", "lang"]).toArrow().sort_by([("id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    if not rows.num_rows:
        return TextModel([], np.zeros((0, BUCKETS)))
    return fit(rows.column("text").combine_chunks(), rows.column("lang").to_pylist())


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def evidence(pages: DataFrame, model: TextModel, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, host, local array<double>): log evidence of text, markup and address for each language."""
    names = model.languages
    held = pages.sparkSession.sparkContext.broadcast(model)
    h = host(F.col(url_col))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    path = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^?#]*?://[^/?#]*/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    codes = F.array(path, F.substring_index(h, ".", 1), F.substring_index(h, ".", -1))
    address = F.coalesce(F.get(F.filter(codes, lambda c: c.isin(names)), 0), F.lit("")) if names else F.lit("")
    kind = pages.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        n = max(1, len(m.languages))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                score = m.scores(pa.array([visible(x) for x in part.column(2).to_pylist()], pa.large_string()))
                for column, trust in ((3, DECLARED), (4, ADDRESS)):
                    for i, said in enumerate(part.column(column).to_pylist()):
                        if said in m.languages:
                            score[i] += np.log((1 - trust) / n)
                            score[i, m.languages.index(said)] += np.log((trust + (1 - trust) / n) / ((1 - trust) / n))
                score -= np.logaddexp.reduce(score, axis=1, keepdims=True) if len(m.languages) else 0
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(score), pa.list_(pa.float64()))], [id_col, "host", "local"])

    cols = pages.select(id_col, h.alias("host"), F.col(html_col).alias("html"), declared.alias("declared"), address.alias("address"))
    return cols.mapInArrow(stages.tidied(run), f"`{id_col}` {kind}, host string, local array<double>")


def _sums(n: int, of: str) -> list[Column]:
    return [F.sum(F.col(of)[k]).alias(f"c{k}") for k in range(n)]


def identified(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, lang, p) for every page: the most probable language and its posterior probability."""
    n = len(model.languages)
    if not n:
        return pages.select(id_col, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("p"))
    own = stages.written(evidence(pages, model, id_col, url_col, html_col), "evidence")
    soft = own.select("host", F.transform("local", lambda x: F.exp(x)).alias("s"))
    counts = F.array(*(f"c{k}" for k in range(n)))
    hosts = soft.groupBy("host").agg(*_sums(n, "s")).select("host", counts.alias("n_host"))
    hosts = hosts.withColumn("name", F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)).withColumn("suffix", F.substring_index("host", ".", -1))
    names = hosts.groupBy("name", "suffix").agg(*_sums(n, "n_host")).select("name", "suffix", counts.alias("n_name"))
    suffixes = names.groupBy("suffix").agg(*_sums(n, "n_name")).select("suffix", counts.alias("n_suffix"))
    top = [x or 0.0 for x in suffixes.agg(*_sums(n, "n_suffix")).first()]  # one number a language
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def smooth(counts_: Column, above: Column) -> Column:
        return F.zip_with(counts_, above, lambda c, p: (c + STRENGTH * p) / (total(counts_) + STRENGTH))

    every = F.array(*(F.lit((c + 1.0) / (sum(top) + n)) for c in top))
    levels = hosts.join(names, ["name", "suffix"]).join(suffixes, "suffix")
    levels = levels.withColumn("p_suffix", smooth(F.col("n_suffix"), every)).withColumn("p_name", smooth(F.col("n_name"), F.col("p_suffix"))).select("host", "n_host", "p_name")
    fused = own.join(levels, "host")
    rest = F.zip_with("n_host", F.transform("local", lambda x: F.exp(x)), lambda c, s: F.greatest(c - s, F.lit(0.0)))
    fused = fused.withColumn("rest", rest)
    fused = fused.withColumn("post", F.zip_with("local", smooth(F.col("rest"), F.col("p_name")), lambda x, p: x + F.log(p)))
    best = F.array_max("post")
    p = 1.0 / total(F.transform("post", lambda x: F.exp(x - best)))
    place = F.array_position("post", best).cast("int")
    return fused.select(id_col, F.element_at(F.array(*(F.lit(x) for x in model.languages)), place).alias("lang"), p.alias("p"))
