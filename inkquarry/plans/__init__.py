"""The registered queries of the core."""


def all_registries():
    from . import checks, core, edits, language, nested, reports

    return [core.R, checks.R, edits.R, language.R, nested.R, reports.R]
