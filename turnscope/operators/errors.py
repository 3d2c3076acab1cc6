"""Failures with the exit code they lead to."""


class RequestError(Exception):
    code = 1

    def __init__(self, message: str):
        super().__init__(message)
        self.message = message


class BadRequest(RequestError):
    code = 2


class Unknown(RequestError):
    """Nothing, or more than one thing, has that name."""

    code = 3
