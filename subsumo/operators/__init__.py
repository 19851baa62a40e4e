"""DataFrame operators: cells, attribute groups, unary and n-ary checks, candidates."""
