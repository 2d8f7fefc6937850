"""Fixed windows of the test fixtures (FIXTURES.md §3)."""

DATA_START = "2024-01-01"
FC_START = "2024-01-22"          # forecast / validation window [FC_START, FC_END)
FC_END = "2024-01-29"
HOLDOUT = "2024-01-24"           # holdout from here to the end of the data
PROFILE_START = "2024-01-08"     # client-profile sample [PROFILE_START, PROFILE_END)
PROFILE_END = "2024-01-22"
AS_OF = "2024-01-15"             # visibility cutoff example
RECENT_DAYS = 14
N_WINDOWS = 5
APPROACH_WINDOWS = 10
REFIT_EVERY = 2
HORIZON = 96
PREVIEW_ROWS = 100
ENSEMBLE_WEIGHTS = {"SeasonalNaive": 0.6, "SeasonalNaive672": 0.4}
TEAM_NAME = "wattline_team"
SUBMITTED_AT = "2024-01-21 12:00:00"
