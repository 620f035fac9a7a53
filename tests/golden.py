"""Published result rows (fixed values), to hold the aggregations against."""

#: system, real percentage, seed, weighted_f1, abnormal_f1, abnormal_recall, pr_auc, false_alarm_rate, tn, fp, fn, tp
SEED_RUNS = [
    ("TT", 0.0, 42, 0.624799, 0.555858, 0.566667, 0.568876, 0.335526, 505, 255, 234, 306),
    ("SN", 0.0, 42, 0.478843, 0.767847, 0.999291, 0.631765, 1.0, 0, 851, 1, 1409),
    ("TT", 10.0, 42, 0.635978, 0.573226, 0.590741, 0.595598, 0.334211, 506, 254, 221, 319),
    ("SN", 10.0, 42, 0.640978, 0.721992, 0.740426, 0.79154, 0.514689, 413, 438, 366, 1044),
    ("TT", 30.0, 42, 0.638439, 0.577818, 0.598148, 0.598754, 0.335526, 505, 255, 217, 323),
    ("SN", 30.0, 42, 0.654296, 0.749835, 0.803546, 0.799903, 0.562867, 372, 479, 277, 1133),
    ("TT", 100.0, 42, 0.659076, 0.510083, 0.398148, 0.596712, 0.115789, 672, 88, 325, 215),
    ("SN", 100.0, 42, 0.663853, 0.758484, 0.816312, 0.820341, 0.556992, 377, 474, 259, 1151),
    ("TT", 0.0, 43, 0.635385, 0.561111, 0.561111, 0.580114, 0.311842, 523, 237, 237, 303),
    ("SN", 0.0, 43, 0.479053, 0.768183, 1.0, 0.632425, 1.0, 0, 851, 0, 1410),
    ("TT", 10.0, 43, 0.634907, 0.552507, 0.540741, 0.608487, 0.296053, 535, 225, 248, 292),
    ("SN", 10.0, 43, 0.647067, 0.723597, 0.73617, 0.79364, 0.494712, 430, 421, 372, 1038),
    ("TT", 30.0, 43, 0.648199, 0.569811, 0.559259, 0.628054, 0.286842, 542, 218, 238, 302),
    ("SN", 30.0, 43, 0.65598, 0.725345, 0.72766, 0.811265, 0.46181, 458, 393, 384, 1026),
    ("TT", 100.0, 43, 0.683972, 0.549708, 0.435185, 0.651914, 0.105263, 680, 80, 305, 235),
    ("SN", 100.0, 43, 0.665551, 0.753099, 0.797163, 0.820941, 0.529965, 400, 451, 286, 1124),
    ("TT", 0.0, 44, 0.640964, 0.559242, 0.546296, 0.596804, 0.289474, 540, 220, 245, 295),
    ("SN", 0.0, 44, 0.479053, 0.768183, 1.0, 0.628461, 1.0, 0, 851, 0, 1410),
    ("TT", 10.0, 44, 0.636506, 0.535857, 0.498148, 0.617696, 0.256579, 565, 195, 271, 269),
    ("SN", 10.0, 44, 0.644287, 0.722917, 0.738298, 0.78951, 0.504113, 422, 429, 369, 1041),
    ("TT", 30.0, 44, 0.638881, 0.562908, 0.559259, 0.619972, 0.303947, 529, 231, 238, 302),
    ("SN", 30.0, 44, 0.649788, 0.766898, 0.860993, 0.802942, 0.636898, 309, 542, 196, 1214),
    ("TT", 100.0, 44, 0.680844, 0.542012, 0.424074, 0.640277, 0.1, 684, 76, 311, 229),
    ("SN", 100.0, 44, 0.659721, 0.754705, 0.810638, 0.813929, 0.559342, 375, 476, 267, 1143),
    ("TT", 0.0, 45, 0.634466, 0.55896, 0.557407, 0.617327, 0.310526, 524, 236, 239, 301),
    ("SN", 0.0, 45, 0.479053, 0.768183, 1.0, 0.628742, 1.0, 0, 851, 0, 1410),
    ("TT", 10.0, 45, 0.662713, 0.582375, 0.562963, 0.63672, 0.263158, 560, 200, 236, 304),
    ("SN", 10.0, 45, 0.634616, 0.717346, 0.73617, 0.793756, 0.524089, 405, 446, 372, 1038),
    ("TT", 30.0, 45, 0.658906, 0.57799, 0.559259, 0.646951, 0.267105, 557, 203, 238, 302),
    ("SN", 30.0, 45, 0.66416, 0.755644, 0.807092, 0.815736, 0.545241, 387, 464, 272, 1138),
    ("TT", 100.0, 45, 0.682969, 0.540865, 0.416667, 0.650121, 0.088158, 693, 67, 315, 225),
    ("SN", 100.0, 45, 0.669681, 0.765303, 0.829078, 0.824011, 0.559342, 375, 476, 241, 1169),
    ("TT", 0.0, 46, 0.653803, 0.588879, 0.598148, 0.615207, 0.307895, 526, 234, 217, 323),
    ("SN", 0.0, 46, 0.479053, 0.768183, 1.0, 0.629201, 1.0, 0, 851, 0, 1410),
    ("TT", 10.0, 46, 0.645239, 0.584753, 0.603704, 0.621672, 0.327632, 511, 249, 214, 326),
    ("SN", 10.0, 46, 0.624675, 0.709945, 0.729078, 0.796205, 0.53819, 393, 458, 382, 1028),
    ("TT", 30.0, 46, 0.657177, 0.536638, 0.461111, 0.633617, 0.182895, 621, 139, 291, 249),
    ("SN", 30.0, 46, 0.647086, 0.762932, 0.852482, 0.810281, 0.633373, 312, 539, 208, 1202),
    ("TT", 100.0, 46, 0.667554, 0.526316, 0.416667, 0.621799, 0.118421, 670, 90, 315, 225),
    ("SN", 100.0, 46, 0.657982, 0.761102, 0.832624, 0.820402, 0.588719, 350, 501, 236, 1174),
]
#: system, real percentage, runs, then mean and deviation of each metric
SEED_SUMMARY = [
    ("SN", 0.0, 5, 0.479011000, 0.000093915, 0.768115800, 0.000150264, 0.999858200, 0.000317074, 0.630118800, 0.001838122, 1.000000000, 0.000000000),
    ("SN", 10.0, 5, 0.638324600, 0.008931484, 0.719159400, 0.005701514, 0.736028400, 0.004267263, 0.792930200, 0.002526881, 0.515158600, 0.016959412),
    ("SN", 30.0, 5, 0.654262000, 0.006565720, 0.752130800, 0.016354116, 0.810354600, 0.052996141, 0.808025400, 0.006458530, 0.568037800, 0.072182394),
    ("SN", 100.0, 5, 0.663357600, 0.004668076, 0.758538600, 0.004914693, 0.817163000, 0.014355396, 0.819924800, 0.003676964, 0.558872000, 0.020799244),
    ("TT", 0.0, 5, 0.637883400, 0.010630686, 0.564810000, 0.013586416, 0.565925800, 0.019492953, 0.595665600, 0.021283288, 0.311052600, 0.016397059),
    ("TT", 10.0, 5, 0.643068600, 0.011732105, 0.565743600, 0.020990257, 0.559259400, 0.042004954, 0.616034600, 0.015305613, 0.295526600, 0.035679681),
    ("TT", 30.0, 5, 0.648320400, 0.009711506, 0.565033000, 0.017065763, 0.547407200, 0.051095642, 0.625469600, 0.017877756, 0.275263000, 0.057417059),
    ("TT", 100.0, 5, 0.674883000, 0.011035197, 0.533796800, 0.015723565, 0.418148200, 0.013507068, 0.632164600, 0.023144193, 0.105526200, 0.012286817),
]
#: six similarities of structure and the kernel one, two of timing, three of labels and the valid mass
#: -> structure, timing, semantic and overall means
FIDELITY = [
    ((0.991000, 0.580000, 0.400000, 0.400000, 0.479000, 0.337097, 0.782033, 0.656000, 0.976984, 0.673723, 0.433452, 0.114544, 0.093835), (0.567019, 0.816492, 0.328889, 0.570800)),
    ((0.965000, 0.586000, 0.394000, 0.397000, 0.488000, 0.352550, 0.789549, 0.707000, 0.970892, 0.669257, 0.446644, 0.112023, 0.090576), (0.567443, 0.838946, 0.329625, 0.578671)),
    ((0.978000, 0.583000, 0.397000, 0.398500, 0.483500, 0.344578, 0.793565, 0.682500, 0.974713, 0.671985, 0.440408, 0.113476, 0.092259), (0.568306, 0.828607, 0.329532, 0.575482)),
    ((0.988000, 0.531000, 0.260000, 0.230000, 0.489000, 0.629401, 0.634799, 0.127000, 0.682305, 0.558101, 0.551538, 0.504315, 0.759871), (0.537457, 0.404652, 0.593456, 0.511855)),
    ((0.972000, 0.599000, 0.553000, 0.419000, 0.577000, 0.744276, 0.719248, 0.137000, 0.642709, 0.640507, 0.629189, 0.580774, 0.817979), (0.654789, 0.389854, 0.667112, 0.570585)),
    ((0.985500, 0.565000, 0.425500, 0.324500, 0.533000, 0.685414, 0.689227, 0.132500, 0.668140, 0.601322, 0.592775, 0.546045, 0.788202), (0.601163, 0.400320, 0.632086, 0.544523)),
    ((0.988000, 0.988000, 0.988000, 0.990000, 0.991000, 0.956112, 0.986804, 0.907000, 0.978641, 0.986172, 0.981663, 0.980824, 1.000000), (0.983988, 0.942821, 0.987165, 0.971324)),
    ((0.972000, 0.972000, 0.972000, 0.972000, 0.977000, 0.961692, 0.989665, 0.911000, 0.973096, 0.973452, 0.973985, 0.970308, 1.000000), (0.973765, 0.942048, 0.979436, 0.965083)),
    ((0.985500, 0.985500, 0.985500, 0.985500, 0.987000, 0.958868, 0.986244, 0.927500, 0.977046, 0.984338, 0.980636, 0.979939, 1.000000), (0.982016, 0.952273, 0.986228, 0.973506)),
    ((0.975000, 0.973000, 0.683000, 0.612000, 0.836000, 0.656519, 0.851774, 0.688000, 0.974965, 0.563078, 0.817364, 0.102544, 0.077602), (0.798185, 0.831482, 0.390147, 0.673271)),
    ((0.957000, 0.950000, 0.686000, 0.569000, 0.839000, 0.629068, 0.858541, 0.767000, 0.972108, 0.536322, 0.796758, 0.108302, 0.084173), (0.784087, 0.869554, 0.381389, 0.678343)),
    ((0.966000, 0.969000, 0.684500, 0.591500, 0.851500, 0.643210, 0.857108, 0.731500, 0.973582, 0.550465, 0.809979, 0.105942, 0.080788), (0.794688, 0.852541, 0.386794, 0.678008)),
    ((0.973000, 0.444000, 0.333000, 0.115000, 0.495000, 0.534007, 0.604433, 0.229000, 0.693977, 0.717078, 0.554248, 0.554248, 1.000000), (0.499777, 0.461489, 0.706393, 0.555886)),
    ((0.986000, 0.805000, 0.724000, 0.532000, 0.718000, 0.841259, 0.721414, 0.126000, 0.613168, 0.801178, 0.698414, 0.698414, 1.000000), (0.761096, 0.369584, 0.799502, 0.643394)),
    ((0.992000, 0.624500, 0.555500, 0.323500, 0.629000, 0.676777, 0.673224, 0.184500, 0.673992, 0.768657, 0.638586, 0.638586, 1.000000), (0.639215, 0.429246, 0.761457, 0.609973)),
    ((0.973000, 0.563000, 0.626000, 0.332000, 0.667000, 0.415231, 0.802399, 0.630000, 0.164247, 0.417167, 0.166873, 0.166873, 1.000000), (0.625519, 0.397124, 0.437728, 0.486790)),
    ((0.986000, 0.559000, 0.622000, 0.307000, 0.585000, 0.461224, 0.781420, 0.488000, 0.295610, 0.601757, 0.286597, 0.286597, 1.000000), (0.614521, 0.391805, 0.543738, 0.516688)),
    ((0.992000, 0.561000, 0.624000, 0.319500, 0.626000, 0.436603, 0.808218, 0.573500, 0.230378, 0.540342, 0.281953, 0.281953, 1.000000), (0.623903, 0.401939, 0.526062, 0.517301)),
]
