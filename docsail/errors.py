"""The one error type of the engine: a short code, an HTTP-like status and a message."""


class EngineError(Exception):
    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code, self.message = status, code, message


def bad_request(message: str) -> EngineError:
    return EngineError(400, "BAD_REQUEST", message)


def not_found(message: str) -> EngineError:
    return EngineError(404, "NOT_FOUND", message)


def conflict(message: str) -> EngineError:
    return EngineError(409, "CONFLICT", message)
