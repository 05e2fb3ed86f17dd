"""Word lists, patterns, limits and sentences that results depend on.

Everything here is a value that has to be exactly as it is for the results to come out right.
"""

# --- roles -----------------------------------------------------------------------------------
ROLES = ("geometry", "mesh", "bc", "deformation", "stress", "x_bc", "x_deformation", "x_stress", "x_other", "unused", "unknown")
CASE_ROLES = ("bc", "deformation", "stress", "x_bc", "x_deformation", "x_stress", "x_other")
MAIN_ROLES = ("bc", "deformation", "stress")
EXTRA_ROLES = ("x_bc", "x_deformation", "x_stress", "x_other")
PICTURE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")

# --- numbers in recognised text ----------------------------------------------------------------
NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"

# --- what a file name tells, in the order the rules are tried -------------------------------------
NAME_ROLES = (
    ("bc", r"(?<![a-z])(bc|bcs|boundary|support|supports|setup|set[-_ ]?up|constraints?|loads?|loading)(?![a-z])"),
    ("deformation", r"deform|displac|(?<![a-z])(td|def|usum|disp)(?![a-z])"),
    ("stress", r"stress|von|mises|equiv|(?<![a-z])(vm|eqv|sigma)(?![a-z])"),
    ("mesh", r"mesh|element|grid"),
    ("geometry", r"geom|model|cad|(?<![a-z])(top|bottom|iso|isometric|front|rear|plan)(?![a-z])"),
)
NAME_CASE = r"(?<![a-z])(?:load[-_ ]?case|case|lc|c)[-_ ]?(\d{1,2})(?!\d)"
NAME_SECTION = r"(?<![a-z])(section|sect|cut|cross)"
NAME_DETAIL = r"(?<![a-z])(detail|zoom|close|hot[-_ ]?spot|local|enlarg)"

# --- title block -------------------------------------------------------------------------------
HEAD_LETTER = r"^\W*([A-Z])\s*[:;]\s*(\S.*)$"
HEAD_JUNK = r"(\s+[a-z]{1,2})+$"
HEAD_TYPE = r"(?i)^\W*Type\s*[:;]\s*(.+)$"
HEAD_UNIT = r"Unit\s*[:;]\s*([A-Za-z/²^0-9]+)"
HEAD_STRESS = r"von[- ]?mises|equivalent\s*(\(.*?\))?\s*stress"
HEAD_OTHER = (r"deformation|stress|strain|safety factor|displacement|reaction|energy|fatigue|damage|shear|principal"
              r"|intensity")
HEAD_STATIC = r"static structural|transient structural|steady-state|modal|harmonic|buckling"

# --- colour legend and setup legend --------------------------------------------------------------
IS_MAX = rf"(?i)({NUM})\s*M[aeo]\s*x\b"
IS_MIN = rf"(?i)({NUM})\s*M[il1I]\s*n\b"
ENDS_IN_NUMBER = rf"(?<![\d.])({NUM})\s*$"
SETUP_WORDS = (r"support|pressure|gravity|force|moment|displacement|load|temperature|fixed|cylindrical|frictionless"
               r"|convection|heat|bearing|remote|torque|acceleration|velocity|rotation|spring|pretension")
SETUP_NOT = r"(?i)^(static|transient|time)\b"
SETUP_JUNK = (
    r"^[\(\[\{]\s*[A-Za-z]{1,2}\s*[\)\]\}]?\s+",
    r"^\s*[A-Za-z]{0,2}[\]\)\}\|]\s*",
    r"\s+[A-Za-z]?[\]\}]$",
    r"^[^A-Za-z]+",
    r"\s+['`\"|,.;:]+$",
)
PRESSURE_TO_MPA = {"mpa": 1.0, "pa": 1e-6, "kpa": 1e-3, "bar": 0.1, "psi": 0.00689476, "mmwc": 9.80665e-6}
WATER = 9.80665
REPAIR_FACTORS = (0.1, 0.01, 10.0, 100.0, 0.001, 1000.0)

# --- limits ------------------------------------------------------------------------------------
MESH_EDGE = 0.075
EDGE_STEP = 60
CALL_SECONDS = 30.0
PICTURE_SECONDS = 60.0
ANALYSIS_SIDE = 3000.0
PLACE_SIDE = 2600.0
DEFAULT_LEGEND_PX = 9.6
SOFT_SHARE = 0.7
SUMMARY_ROWS = 8
BUILDS_KEPT = 6
HISTORY_KEPT = 40
SESSION_DAYS = 7

# regions of a picture as fractions (left, top, right, bottom) and in pixels of a small screenshot
REGIONS = {
    "header": ((0.0, 0.0, 0.46, 0.215), (0, 0, 520, 170)),
    "legend": ((0.0, 0.12, 0.27, 0.62), (0, 66, 270, 340)),
    "bc": ((0.028, 0.07, 0.36, 0.46), (15, 38, 355, 253)),
}

# available picture size (width, height in points) by family, layout and position in the pair
# (side by side: left and right column; stacked: half the slide height less heading; single: whole content area)
BOXES = {
    ("pair", "side"): (392.0, 370.0),
    ("pair", "stack"): (852.0, 192.0),
    ("pair", "separate"): (852.0, 440.0),
    ("bc", "side"): (540.0, 395.0),
    ("bc", "stack"): (852.0, 398.0),
}
LAYOUTS = ("side", "stack", "separate")

# --- settings with their defaults ---------------------------------------------------------------
SETTINGS = {
    "report_no_pattern": "FEA/ACK-{job}/01",
    "fos": 1.3,
    "mm_format": "sig3",
    "singularity_factor": 2.0,
    "min_legend_pt": 5.0,
    "show_utilisation": True,
    "missing_pictures": "skip",
    "mesh_limits": {"skew_max_warn": 0.9, "skew_max_info": 0.75, "skew_avg_info": 0.5, "oq_min_warn": 0.1},
    "material": {"material": "IS 2062", "item": "Duct", "E": "191400", "nu": "0.3", "rho": "7.8E-9"},
}
ASSUMPTIONS = (
    "Linear elastic, isotropic material behaviour (no plasticity).",
    "Static loading: inertia and dynamic effects are neglected.",
    "Small-deflection theory (geometric nonlinearity is not considered).",
    "Contacts between parts are bonded (no sliding or separation).",
    "Welds are not modelled in detail (parts are fully fused).",
    "Bolts and pins are idealised (no pre-tension, no thread detail).",
    "Pressure is applied uniformly on the loaded surfaces.",
    "Self weight is included (standard earth gravity).",
    "Temperature effects are not considered.",
    "Buckling, fatigue and vibration are not assessed in this report.",
)
VERSION = "2.2"

# --- words -------------------------------------------------------------------------------------
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "June", "July", "Aug", "Sept", "Oct", "Nov", "Dec")
LOAD_WORDS = ("pressure", "moment", "force", "gravity", "load", "self", "weight", "temperature", "torque")
UNITS = r"(?:mm|cm|m|MPa|GPa|kPa|Pa|N|kN|kg|t|mmWC|Hz|s|rpm|°C|%)"
WHERE = "[location - please confirm]"
VALUE = "[value - please confirm]"
PLACEHOLDER = r"(?i)\[[^\[\]]*(?:please confirm|not entered)[^\[\]]*\]"
BASES = ("asis", "singularity", "refine")
BASIS_TEXT = {
    "asis": "reported as it is (peak stress compared with the allowable)",
    "singularity": "local singularity - the stress away from the peak is reported",
    "refine": "not concluded - the model must be refined",
}
LEVELS = {"bad": 0, "warn": 1, "info": 2, "ok": 3}

# --- sentences of the observations -----------------------------------------------------------------
SAY = {
    "def": "Total deformation in the {obj} is {d} mm.",
    "def_within": "Total deformation in the {obj} is {d} mm, which is within the allowable deformation limit of {lim} mm.",
    "def_exceeds": "Total deformation in the {obj} is {d} mm, which is exceeding the allowable deformation limit of {lim} mm.",
    "def_loc": "The maximum deformation occurs at {loc}.",
    "stress_loc": "The maximum von-Mises stress occurs at {loc}.",
    "neutral": "Von-Mises stress in the {obj} is {s} MPa.",
    "neutral_close": "[Conclusion - please confirm after entering the yield stress.]",
    "over": "Von-Mises stress in the {obj} exceeds the materials allowable stress limit of {allow} MPa.",
    "within": "Von-Mises stress in the {obj} ({s} MPa) is within the materials allowable stress limit of {allow} MPa.",
    "within_util": "Von-Mises stress in the {obj} ({s} MPa) is within the materials allowable stress limit of {allow} MPa"
                   " (utilisation {util} %).",
    "close_ok": "Therefore, the {obj} is structurally adequate to withstand the applied load under this load case.",
    "close_bad": "Therefore, the {obj} is structurally inadequate to withstand the applied load under this load case.",
    "close_def": "Therefore, the {obj} is structurally adequate in strength, but the deformation exceeds the allowable limit.",
    "sing": "The peak von-Mises stress of {s} MPa occurs locally at {loc} and is a stress singularity of the idealisation"
            " (mesh-dependent), not a representative stress.",
    "away_none": "Away from this region the von-Mises stress is [value - please confirm] MPa.",
    "away_none_close": "[Conclusion - please confirm after entering the stress away from the peak.]",
    "away_ok": "Away from this region the von-Mises stress is {away} MPa, which is within the materials allowable stress"
               " limit of {allow} MPa.",
    "away_ok_close": "Therefore, the {obj} is structurally adequate to withstand the applied load under this load case,"
                     " based on the stress away from the singularity.",
    "away_bad": "Away from this region the von-Mises stress is {away} MPa, which exceeds the materials allowable stress"
                " limit of {allow} MPa.",
    "refine": "The peak von-Mises stress of {s} MPa ({times} times the allowable limit of {allow} MPa) occurs at {loc} and"
              " is mesh-dependent.",
    "refine_close": "A conclusion on the structural adequacy cannot be drawn until the model is refined at this location.",
    "above_yield": "The peak stress ({s} MPa) is above the yield strength of {sy} MPa; at that location the linear-elastic"
                   " result is indicative only.",
    "reaction": "Reaction force check: the sum of the reactions is {rs} N against an applied load of {ra} N"
                " (difference {diff} %).",
}
ACTIONS = "Need to take corrective actions."
REFINE_FIRST = "Model refinement required."
EXCEEDS = "Exceeding Limit"
CAPTION = {
    "def": "Maximum Total Deformation – {d} mm",
    "neutral": "Maximum Von-Mises Stress – {s} MPa",
    "over": "The stress exceeds the materials allowable limit of {allow} MPa.",
    "within": "The stress is within the materials allowable limit of {allow} MPa.",
    "away_none": "The peak stress is a local singularity; the stress away from it is [value - please confirm] MPa.",
    "away_ok": "The peak stress is a local singularity; the stress away from it is within the materials allowable limit of"
               " {allow} MPa.",
    "away_bad": "The peak stress is a local singularity; the stress away from it exceeds the materials allowable limit of"
                " {allow} MPa.",
    "refine": "The peak stress is mesh-dependent: the model must be refined before a conclusion is drawn.",
}

# --- sentences of the setup list -----------------------------------------------------------------
SETUP_SAY = {
    "gravity": "Self weight considered.",
    "pressure": "Design pressure {mm} mmWC applied which is {mpa} MPa.",
    "moment": "Moment of {v} N·mm ({nm} N·m) applied at [location - please confirm].",
    "moment_only": "Moment applied at [location - please confirm].",
    "force": "Force of {v} N applied at [location - please confirm].",
    "cylindrical": "Cylindrical support applied on [location - please confirm].",
    "frictionless": "Frictionless support applied on [location - please confirm].",
    "remote_displacement": "Remote displacement applied at [location - please confirm].",
    "displacement": "Free displacement of [x] mm in [axis] direction.",
    "fixed": "Fixed support applied on [location - please confirm].",
    "temperature": "Temperature of {v} °C applied.",
    "other": "[{line} - please describe]",
}

# --- sentences of the checks -----------------------------------------------------------------------
CHECK_SAY = {
    "stress_unit": "Case {n}: the stress picture says its unit is \"{u}\", not MPa - check the number.",
    "def_unit": "Case {n}: the deformation picture says its unit is \"{u}\", not mm - check the number.",
    "gravity_mm": "Case {n}: gravity is {v} {u} - in a mm-tonne-second model it must be 9806.65 mm/s².",
    "gravity_m": "Case {n}: gravity is {v} {u} - it should be 9.80665 m/s².",
    "pass": "Case {n}: maximum stress {s} MPa is within the allowable {allow} MPa (utilisation {util} %).",
    "exceeds": "Case {n}: maximum stress {s} MPa is {times}x the allowable {allow} MPa (below the yield strength). The report"
               " will say it exceeds the limit and needs corrective action.",
    "beyond_yield": "Case {n}: maximum stress {s} MPa is above the yield strength ({sy} MPa, {times}x). The linear-elastic"
                    " result is only indicative there; a note to that effect is added to the observations.",
    "suspect_set": "Case {n}: peak stress {s} MPa ({times}x yield) - reported as: {basis}.",
    "suspect": "Case {n}: maximum stress {s} MPa is {times}x the YIELD strength - far beyond what a real structure carries."
               " This is almost always a stress singularity (point support, sharp corner, contact edge) or a load / unit"
               " error. Decide how to report it (box below the results of this case).",
    "away_above_yield": "Case {n}: even the stress 'away from the peak' ({away} MPa) is above the yield strength - is it"
                        " really away from the singularity?",
    "no_red": "Case {n}: the stress is over the limit, but I cannot see any red zone in the stress picture (the hot spot may"
              " be tiny or hidden). A zoomed picture of the hot spot would support the statement.",
    "no_cap": "Case {n}: the stress legend is not stretched to the allowable stress, so its colours do not show where the"
              " limit is exceeded. Consider setting the ANSYS legend so the top band starts at {allow} MPa.",
    "cap_off": "Case {n}: the top colour band of the stress legend starts at {cap} MPa, but the allowable stress is {allow}"
               " MPa. Red in the picture does not then mean \"over the limit\" - check the yield stress / FOS.",
    "cap_ok": "Case {n}: the legend's top band starts at {cap} MPa = the allowable stress, so red = over the limit.",
    "def_limit": "Case {n}: deformation {d} mm exceeds the allowable deformation of {lim} mm.",
    "extra": "Case {n}: the additional {kind} view '{heading}' shows Max {m} - larger than the main plot's Max {main}. A"
             " section cannot exceed the model maximum: check both readings.",
    "reaction_bad": "Case {n}: reactions {rs} N vs applied {ra} N - difference {diff} % (more than 2 %: the load path or a"
                    " constraint needs a look).",
    "reaction_ok": "Case {n}: reactions {rs} N vs applied {ra} N - difference {diff} %.",
    "fos": "The factor of safety is {v} - below 1 the allowable stress is higher than the yield strength.",
    "rho_kg_m3": "Density {v} looks like kg/m³ (steel 7850). In tonne/mm³ steel is 7.85E-9 - a unit mix-up here is a classic"
                 " blunder.",
    "rho_kg_mm3": "Density {v} looks like kg/mm³ (steel 7.85E-6). In tonne/mm³ steel is 7.85E-9.",
    "rho_range": "Density {v} is outside the usual range for tonne/mm³ (steel 7.85E-9, aluminium 2.7E-9) - check the units.",
    "e_low": "Young's modulus {v} looks like GPa - the table is in MPa (steel about 200000).",
    "e_high": "Young's modulus {v} is very high for MPa - is it in Pa or psi?",
    "nu": "Poisson's ratio {v} must lie between 0 and 0.5.",
    "skew_bad": "Maximum skewness {v} is in ANSYS's 'bad (sliver)' range (>= {lim}). Check where these elements are, especially"
                " if they sit in the high-stress region.",
    "skew_poor": "Maximum skewness {v} is in ANSYS's 'poor' range ({lo}-{lim}) - acceptable only away from the hot spots.",
    "skew_avg": "Average skewness {v} is high (a good mesh averages below about {lim}).",
    "oq": "Minimum orthogonal quality {v} is below {lim} (ANSYS guidance: keep it above 0.1).",
    "same_name": "Two load cases have the same name. Give every case its own name (what is different between them?).",
    "no_yield": "Enter the yield stress in the Material table - the pass / fail wording is written from it.",
    "no_evidence": "Reviewers usually ask for the mesh statistics, the location of the maximum stress and the modelling"
                   " assumptions. All optional - see \"Engineering evidence\".",
    "nothing": "Nothing unusual found.",
    "note": "{name}: {note}",
    "same_picture": "{name} is the same picture as {first} - used once.",
    "no_case": "{name}: could not tell which load case it belongs to - choose the case in the table.",
    "slot_bc": "Case {n} has no setup (boundary-condition) picture - that is fine: the report carries on without it.",
    "slot_deformation": "Case {n} has no total-deformation picture - that is fine: the report carries on without it.",
    "slot_stress": "Case {n} has no von-Mises stress picture - that is fine: the report carries on without it.",
    "demoted": "Case {n}: two {kind} pictures - {main}{max} is the main one, {extra} is used as an additional view. Swap them"
               " in the table if that is wrong.",
    "no_geometry": "No geometry picture - that is fine: the geometry slide is simply left out (or add one in the pictures"
                   " table).",
    "no_mesh": "No mesh picture - that is fine: the mesh slide is simply left out (or add one in the pictures table).",
    "no_cases": "No load-case pictures (setup / deformation / stress) were recognised - the report would hold the cover,"
                " material, geometry and mesh slides only. Use the pictures table if some pictures were not recognised.",
    "too_small": "The text inside the {what} (legend, axes) will be only about {pt} pt on the slide, and no layout does better"
                 " than {best} pt. Export the pictures larger or cropped closer to the model, or add zoomed views as"
                 " additional views.",
    "better": "The text inside the {what} will be only about {pt} pt with the layout you chose; '{mode}' gives {best} pt.",
    "moved": "The {what} are large / wide, so they are placed '{mode}' to keep the text readable (about {pt} pt; side by side"
             " would give {side} pt).",
    "overflow": "The list of loads and supports is long - it may run off the setup slide. Shorten the sentences or move some"
                " to Notes.",
}
KIND_LABEL = {"bc": "setup", "deformation": "total-deformation", "stress": "von-Mises stress"}
FAMILY_LABEL = {"results": "result plots", "geometry": "geometry / mesh views", "bc": "setup picture", "extras": "additional views"}

# --- notes of the report ------------------------------------------------------------------------------
NOTE_SAY = {
    "geometry_frame": "Geometry: no picture - an empty frame was kept on the geometry slide.",
    "geometry_out": "Geometry slide left out: no geometry picture.",
    "mesh_frame": "Mesh: no picture - an empty frame was kept on the mesh slide.",
    "mesh_frame_stats": "Mesh: no picture - an empty frame was kept on the mesh slide (it carries the mesh statistics).",
    "mesh_out": "Mesh slide left out: no mesh picture.",
    "frame": "Case {n}: {what} picture missing - an empty frame was kept.",
    "setup_list_only": "Case {n}: no setup picture - the setup slide holds the list of loads and supports only.",
    "setup_out": "Case {n}: setup slide left out (no setup picture and no list of loads and supports).",
    "results_out": "Case {n}: results slide left out (no deformation and no stress picture).",
    "results_one": "Case {n}: only one result picture - it fills the slide.",
    "no_observation": "Case {n}: observation slide left out (no numbers to write about).",
    "no_cases": "No load cases: the report holds the cover, material, geometry and mesh slides only.",
}
SLOT_LABEL = {"bc": "Setup", "deformation": "Total deformation", "stress": "Von-Mises stress"}
