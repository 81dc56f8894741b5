"""What can go wrong, by kind. Every error the engine raises on purpose is an ``EngineError``."""


class EngineError(Exception):
    pass


class QueryError(EngineError):
    """Blank SQL or no statement."""


class ParseError(EngineError):
    """Text or a statement that the grammar doesn't allow."""


class UnknownColumn(EngineError):
    pass


class AmbiguousColumn(EngineError):
    pass


class DuplicateColumn(EngineError):
    pass


class TableNotFound(EngineError):
    pass


class DatabaseNotFound(EngineError):
    pass


class AlreadyExists(EngineError):
    pass


class NoDatabaseSelected(EngineError):
    pass


class AggregationError(EngineError):
    pass


class TypeError_(EngineError):
    """Values or columns of types that can't be compared or summed."""


class InsertError(EngineError):
    pass


class UpdateError(EngineError):
    pass


class InvalidSchema(EngineError):
    pass


class IndexError_(EngineError):
    pass


class RecordNotFound(EngineError):
    pass


class CorruptManifest(EngineError):
    pass
