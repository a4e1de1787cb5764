"""Errors of reading and compiling rules."""


class RuleError(Exception):
    """Any rule text that cannot be used."""


class ParseError(RuleError):
    """The text is not in the rule grammar; ``line`` is where."""

    def __init__(self, message: str, file: str | None = None, line: int = 0):
        super().__init__(f"{file or '<string>'}:{line}: {message}")
        self.file, self.line = file, line


class RuleFileError(RuleError):
    """A rule, phrase or address file that cannot be read."""


class UnknownVariable(RuleError):
    pass


class UnknownOperator(RuleError):
    pass


class UnknownTransformation(RuleError):
    pass


class UnknownAction(RuleError):
    pass


class InvalidArgument(RuleError):
    """An action's or operator's argument that has no meaning."""
