"""A corpus from documents to training sequences: stages that run one after another.

Each stage takes (spark, documents, folder of the tables) and works on all that the one
before it kept; all but the last return the columns of documents. What a stage returns is to
be written before the next one begins: a stage first deletes the tables that earlier ones
wrote on their way, unless its documents are read from them.

In every stage: a null id or text stays as it is, and a null text counts as an empty one;
whole texts are read however long (one text is held in memory by one task); repeated rows are
rows of their own; a table without rows gives none; further columns, whatever their names, go
through the first four stages untouched.
"""

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hazecast.llm import mixing, near_copies, packing, repeats, toxicity
from hazecast.llm.common import SHUFFLES_DELETED, delete_folder, noted_tables, table
from hazecast.session import configure, work_folder

_written: list[str] = []


def stage(function):
    """A stage that deletes what earlier stages wrote on their way and its input does not read.

    From the first stage on the session deletes shuffle files as each query ends.
    """
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark).conf.set(SHUFFLES_DELETED, "true")
        read = docs.inputFiles() if _written else []
        for path in [p for p in _written if not any(p.split(":")[-1] in f for f in read)]:
            delete_folder(spark, path)
            _written.remove(path)
        with noted_tables() as tables:
            result = function(spark, docs, sf_dir)
        _written.extend(tables)
        return result
    return run_stage


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from these and ``labels``.

    Empty and null texts are scored like any text; without a toxic label all documents stay.
    """
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


@stage
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with five-word Jaccard >= 0.8, the one of the least id.

    Texts without words, null ones too, are one group. A null id is kept only if its group has
    no other; of rows with one id the least text stays.
    """
    return near_copies.one_of_each(docs)


@stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the repeated passages of over 50 words or of 400 bytes.

    51 words take 101 bytes at least, so repeats of that length find them all. Of what those
    cover, runs of 50 words or fewer and under 400 bytes stay. Every copy of a passage goes,
    the first one too: a repeated row of such length is left with an empty text.
    """
    return repeats.without_repeats(docs, length=101, gram=32, least_words=51)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice is two rows.

    A null source is a source of its own; texts without words go with the others of their place.
    """
    return mixing.mix(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence, with their ids.

    An empty or null text is the end id alone.
    """
    return packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_duplicates),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]
#: A trained classifier and suffix arrays have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES:
        path = work_folder(spark, f"stage-{name}")
        stage_of(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
