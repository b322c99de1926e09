"""Error kinds and the exceptions that carry them."""

from __future__ import annotations

from enum import Enum


class ErrorCode(Enum):
    SUCCESS = 0
    INVALID_ARGUMENT = 1
    IO_ERROR = 2
    MEMORY_LIMIT_EXCEEDED = 3
    NODE_NOT_FOUND = 4
    BUFFER_POOL_FULL = 5
    INDEX_NOT_BUILT = 6
    ALREADY_EXISTS = 7
    NOT_INITIALIZED = 8
    INTERNAL_ERROR = 9


class VectorError(Exception):
    """An error of the engine; ``code`` says which kind."""

    code = ErrorCode.INTERNAL_ERROR


class InvalidArgument(VectorError, ValueError):
    code = ErrorCode.INVALID_ARGUMENT


class ReadError(VectorError, OSError):
    code = ErrorCode.IO_ERROR


class MemoryLimitExceeded(VectorError):
    code = ErrorCode.MEMORY_LIMIT_EXCEEDED


class NodeNotFound(VectorError, KeyError):
    code = ErrorCode.NODE_NOT_FOUND


class BufferPoolFull(VectorError):
    code = ErrorCode.BUFFER_POOL_FULL


class NotInitialized(VectorError):
    code = ErrorCode.NOT_INITIALIZED
