"""The engine's one exception class."""


class LoomError(Exception):
    """An error with a stable ``code`` such as ``TableNotFound`` or ``TypeMismatch``."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
