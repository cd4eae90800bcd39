"""DataFrame operators: knowledge base, graph, walks, vectors, candidates, linking, evaluation."""
