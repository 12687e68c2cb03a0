"""Errors of the engine; all are ValueErrors, so that one except clause is enough."""


class FactError(ValueError):
    pass


class InvalidEntity(FactError):
    pass


class InvalidValue(FactError):
    pass


class NotFound(FactError):
    pass


class ClosureCycle(FactError):
    pass


class DimensionMismatch(FactError):
    pass


class EmptyVector(FactError):
    pass


class ScopeNotFound(NotFound):
    pass


def check_entity(entity: str) -> str:
    """An entity is a non-empty string without a colon."""
    if not isinstance(entity, str) or not entity or ":" in entity:
        raise InvalidEntity(f"not an entity id: {entity!r}")
    return entity


def check_id(value: str, what: str = "doc_id") -> str:
    if not isinstance(value, str) or not value:
        raise InvalidValue(f"{what} must not be empty")
    return value
