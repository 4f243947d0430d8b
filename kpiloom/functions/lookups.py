"""These must equal the published data definitions exactly."""

# Brazilian state code -> region.
STATE_REGION = {
    "AC": "North", "AL": "Northeast", "AM": "North", "AP": "North", "BA": "Northeast",
    "CE": "Northeast", "DF": "Center-West", "ES": "Southeast", "GO": "Center-West",
    "MA": "Northeast", "MG": "Southeast", "MS": "Center-West", "MT": "Center-West",
    "PA": "North", "PB": "Northeast", "PE": "Northeast", "PI": "Northeast", "PR": "South",
    "RJ": "Southeast", "RN": "Northeast", "RO": "North", "RR": "North", "RS": "South",
    "SC": "South", "SE": "Northeast", "SP": "Southeast", "TO": "North",
}
DEFAULT_REGION = "Other"

# Weekday name -> 0..6, Monday first.
WEEKDAY_CODE = {
    "Monday": 0, "Tuesday": 1, "Wednesday": 2, "Thursday": 3,
    "Friday": 4, "Saturday": 5, "Sunday": 6,
}

# Codes used when scoring one employee record outside training.
DEPARTMENT_CODE = {"Human Resources": 0, "Research & Development": 1, "Sales": 2}
DEFAULT_DEPARTMENT_CODE = 1
ROLE_CODE = {
    "Healthcare Representative": 0, "Human Resources": 1, "Laboratory Technician": 2,
    "Manager": 3, "Manufacturing Director": 4, "Research Director": 5,
    "Research Scientist": 6, "Sales Executive": 7, "Sales Representative": 8,
}
DEFAULT_ROLE_CODE = 6
GENDER_CODE = {"Male": 1}
OVERTIME_CODE = {"Yes": 1}

# Words that make ad-hoc SQL text unsafe (plain substring test).
BLOCKED_WORDS = (
    "drop", "delete", "insert", "update", "alter", "truncate", "create", "grant",
)

ATTRITION_VALUES = ("Yes", "No")
RISK_TIERS = ("High", "Medium", "Low")

RECOMMENDATION = {
    "High": "Immediate intervention recommended — review workload and compensation.",
    "Medium": "Monitor closely and improve engagement.",
    "Low": "Employee appears stable. Maintain current engagement.",
}

# Characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
