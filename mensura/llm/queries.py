"""Queries of this folder by name, and their SQL where SQL can express them."""

from mensura.llm import bytebpe, decontam, divergence, embeddings, licenses, linededup, quality, secrets, simhash, tokencount, toxicity, trie, warc

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_simhash": simhash.op3_simhash,
    "op4_licenses": licenses.op4_licenses,
    "op5_warc": warc.op5_warc,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_quality": quality.op7_quality,
    "op8_byte_bpe": bytebpe.op8_byte_bpe,
    "op9_embeddings": embeddings.op9_embeddings,
    "embeddings_linked": embeddings.embeddings_linked,
    "op10_secrets": secrets.op10_secrets,
    "op11_line_dedup": linededup.op11_line_dedup,
    "op12_divergence": divergence.op12_divergence,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_decontamination": decontam.OP1_SQL,
    "op4_licenses": licenses.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op9_embeddings": embeddings.OP9_SQL,
    "embeddings_linked": embeddings.LINKED_SQL,
    "op10_secrets": secrets.OP10_SQL,
    "op11_line_dedup": linededup.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
