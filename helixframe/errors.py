"""What can be wrong with files, references and indexes."""


class InvalidGTF(ValueError):
    """A header that is none, or no file at all."""


class InvalidMapping(ValueError):
    """A variant whose alleles are not the reference's."""


class EndOfFile(EOFError):
    """A position behind the last line of a file."""


class ChromosomeNotIndexed(LookupError):
    """A chromosome that a locus table does not have."""
