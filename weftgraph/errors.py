"""Errors of the query layer."""


class QueryError(Exception):
    """Any failure of a graph query."""


class CypherSyntaxError(QueryError):
    def __init__(self, message: str, at: int = 0) -> None:
        super().__init__(f"Cypher syntax error at {at}: {message}")


class CypherExecutionError(QueryError):
    def __init__(self, message: str) -> None:
        super().__init__(f"Cypher execution error: {message}")


class StaleNodeError(QueryError):
    """A node of an earlier result is no longer in the graph."""
