"""Registered queries of packing, of the binary token output and of the alignment of two tokenizers."""

from .align import align
from .common import table
from .dac import read_documents, write_blocks
from .packing import pack_documents
from .tokens import vocabulary


def op5_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048, 0, with_ids=False).drop("spot")


def op9_addressable_ids(spark, sf_dir):
    return read_documents(write_blocks(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op13_tokenizer_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing, "op9_addressable_ids": op9_addressable_ids, "op13_tokenizer_alignment": op13_tokenizer_alignment}
ORACLES = {}
