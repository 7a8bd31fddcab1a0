"""The registered queries: name -> (DataFrame builder, SQL or None)."""


def catalogue() -> dict:
    from lorekeep.queries import corpus, graph, retrieval, wiki

    return retrieval.QUERIES | corpus.QUERIES | graph.QUERIES | wiki.QUERIES
