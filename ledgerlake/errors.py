"""Errors raised for bad input or too little data."""


class LedgerLakeError(Exception):
    pass


class ImportFailed(LedgerLakeError):
    pass


class EmptyDataset(LedgerLakeError):
    pass


class SchemaMismatch(LedgerLakeError):
    pass


class QueryRefused(LedgerLakeError):
    pass


class NotEnoughData(LedgerLakeError):
    pass


class EtlFailed(LedgerLakeError):
    pass
