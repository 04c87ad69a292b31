"""Material facts and published results used as golden values."""

# Catalogue cells as printed by the makers.
RAW_COLUMNS = (
    "Product", "Type", "Melting Temperature (°C)", "Freezing/Congealing Temperature (°C)",
    "Nucleation Temperature (°C)", "Latent Heat - Melting (kJ/kg)",
    "Latent Heat - Freezing (kJ/kg)", "Heat Storage Capacity (Wh/kg)", "Density - Liquid (kg/m³)",
    "Density - Solid (kg/m³)", "Specific Heat - Liquid (kJ/kgK)",
    "Specific Heat - Solid (kJ/kgK)", "Thermal Conductivity - Liquid (W/mK)",
    "Thermal Conductivity - Solid (W/mK)", "Thermal Conductivity - Both Phases (W/mK)",
    "Volume Expansion (%)", "Max Operating Temperature (°C)", "Flammability", "Flash Point (°C)",
    "Number of Cycles Tested",
)
RAW = [
    ('savE® HS36', 'Inorganic', '35', '36', '34', '163', '163', '', '1850', '1967', '2.32', '1.98', '0.47', '0.5', '', '', '90', 'No', '', '~2000'),
    ('savE® OM35', 'Organic', '35', '34', '', '171', '202', '', '870', '900', '2.78', '2.57', '0.16', '0.2', '', '', '90', 'Yes', '200', '~2000'),
    ('savE® OM37', 'Organic', '38', '36', '36', '186', '196', '', '860', '973', '2.63', '2.55', '0.13', '0.16', '', '', '90', 'No', '', '~2000'),
    ('savE® OM39', 'Organic', '39', '35', '', '229', '228', '', '824', '850', '2.4', '2', '0.165', '0.19', '', '', '90 (provisional)', 'No', '', 'Under Trial'),
    ('savE® OM42', 'Organic', '44', '43', '', '199', '190', '', '863', '903', '2.78', '2.71', '0.1', '0.19', '', '', '90', 'Yes', '200', '~2000'),
    ('savE® OM46', 'Organic', '47', '45', '45', '177', '182', '', '880', '917', '2.7', '2.5', '0.1', '0.2', '', '', '90', 'No', '', '~2000'),
    ('savE® OM48', 'Organic', '51', '48', '', '165', '172', '', '875', '960', '2.35', '2.02', '0.1', '0.2', '', '', '90', 'Yes', '200', '~2000'),
    ('savE® OM50', 'Organic', '50', '50', '', '189', '204', '', '859', '961', '2.78', '3.33', '0.14', '0.21', '', '', '90', 'Yes', '200', '~2000'),
    ('RT35', 'Organic (RT-line)', '32-38 (peak: 35)', '38-32 (peak: 35)', '', '160', '', '45', '770', '860', '2', '', '', '', '0.2', '12.5', '65', 'N/A', '165', 'N/A'),
    ('RT38', 'Organic (RT-line)', '34-39 (peak: 38)', '39-34 (peak: 38)', '', '170', '', '47', '750', '880', '2', '', '', '', '0.2', '~12.5', '70', 'N/A', '165', 'N/A'),
    ('RT42', 'Organic (RT-line)', '38-43 (peak: 41)', '43-37 (peak: 42)', '', '165', '', '48', '760', '880', '2', '', '', '', '0.2', '12.5', '72', 'N/A', '186', 'N/A'),
    ('RT44HC', 'Organic (RT-line)', '41-44 (peak: 43)', '44-40 (peak: 43)', '', '250', '', '70', '700', '800', '2', '', '', '', '0.2', '12.5', '70', 'N/A', '>180', 'N/A'),
    ('RT45HC', 'Organic (RT-line)', '45-48 (peak: 47)', '44-47 (peak: 45)', '', '230', '', '64', '~800', '~900', '2', '', '', '', '0.2', '~12', '75', 'N/A', '155', 'N/A'),
    ('RT47', 'Organic (RT-line)', '41-48 (peak: 46)', '48-41 (peak: 47)', '', '160', '', '46', '770', '880', '2', '', '', '', '0.2', '12', '65', 'N/A', '>180', 'N/A'),
    ('RT50', 'Organic (RT-line)', '45-51 (peak: 49)', '51-46 (peak: 50)', '', '160', '', '46', '760', '880', '2', '', '', '', '0.2', '12.5', '70', 'N/A', '>200', 'N/A'),
    ('RT54HC', 'Organic (RT-line)', '53-54 (peak: 54)', '54-53 (peak: 54)', '', '200', '', '56', '850', '990', '2', '', '', '', '0.2', '', '85', 'N/A', 'N/A', 'N/A'),
    ('RT55', 'Organic (RT-line)', '51-57 (peak: 55)', '56-57 (peak: 55)', '', '170', '', '48', '770', '880', '2', '', '', '', '0.2', '14', '90', 'N/A', '>200', 'N/A'),
    ('RT64HC', 'Organic (RT-line)', '63-65 (peak: 64)', '64-61 (peak: 64)', '', '250', '', '70', '~800', '~900', '2', '', '', '', '0.2', '11', '95', 'N/A', '>190', 'N/A'),
]

# The same materials cleaned, filled and scored.
CLEAN_COLUMNS = (
    "product", "pcm_type", "Tm_melting", "Tm_freezing", "Tm_nucleation", "latent_heat_melting",
    "latent_heat_freezing", "heat_storage_Wh_kg", "density_liquid", "density_solid", "Cp_liquid",
    "Cp_solid", "TC_liquid", "TC_solid", "TC_both", "volume_expansion", "max_op_temp",
    "flammability", "flash_point", "cycles_tested", "latent_per_degree", "latent_heat_avg",
    "Tm_range", "rho_H_MJ_m3", "TC_ratio", "Cp_avg", "density_avg", "cycles_confidence",
    "flash_point_known", "pcm_type_code", "flammability_enc", "pcm_suitability_score",
)
CLEAN = [
    ('savE® HS36', 'Inorganic', 35.0, 36.0, 34.0, 163.0, 163.0, 54.0, 1850.0, 1967.0, 2.32, 1.98, 0.47, 0.5, 0.485, 11.75, 90.0, 'No', 166.0, 2000.0, -163.000163000163, 163.0, -1.0, 320.621, 0.94, 2.15, 1908.5, 1.0, 1, 0, 0, 0.7097428030511732),
    ('savE® OM35', 'Organic', 35.0, 34.0, 34.0, 171.0, 202.0, 47.4, 870.0, 900.0, 2.78, 2.57, 0.16, 0.2, 0.18, 12.75, 90.0, 'Yes', 200.0, 2000.0, 170.99982900017102, 186.5, 1.0, 167.85, 0.7999999999999999, 2.675, 885.0, 1.0, 1, 1, 2, 0.2916851524843382),
    ('savE® OM37', 'Organic', 38.0, 36.0, 36.0, 186.0, 196.0, 49.6, 860.0, 973.0, 2.63, 2.55, 0.13, 0.16, 0.145, 12.75, 90.0, 'No', 200.0, 2000.0, 92.99995350002324, 191.0, 2.0, 185.843, 0.8125, 2.59, 916.5, 1.0, 1, 1, 0, 0.2864573491148158),
    ('savE® OM39', 'Organic', 39.0, 35.0, 35.0, 229.0, 228.0, 47.4, 824.0, 850.0, 2.4, 2.0, 0.165, 0.19, 0.1775, 13.2, 90.0, 'No', 198.6, 0.0, 57.249985687503575, 228.5, 4.0, 194.225, 0.868421052631579, 2.2, 837.0, 0.0, 1, 1, 0, 0.2751868272568434),
    ('savE® OM42', 'Organic', 44.0, 43.0, 43.0, 199.0, 190.0, 55.0, 863.0, 903.0, 2.78, 2.71, 0.1, 0.19, 0.145, 12.8, 90.0, 'Yes', 200.0, 2000.0, 198.99980100019903, 194.5, 1.0, 175.6335, 0.5263157894736842, 2.745, 883.0, 1.0, 1, 1, 2, 0.300125229176588),
    ('savE® OM46', 'Organic', 47.0, 45.0, 45.0, 177.0, 182.0, 47.4, 880.0, 917.0, 2.7, 2.5, 0.1, 0.2, 0.15, 12.75, 90.0, 'No', 200.0, 2000.0, 88.49995575002212, 179.5, 2.0, 164.6015, 0.5, 2.6, 898.5, 1.0, 1, 1, 0, 0.2746267129051652),
    ('savE® OM48', 'Organic', 51.0, 48.0, 48.0, 165.0, 172.0, 49.6, 875.0, 960.0, 2.35, 2.02, 0.1, 0.2, 0.15, 12.75, 90.0, 'Yes', 200.0, 2000.0, 54.99998166667277, 168.5, 3.0, 161.76, 0.5, 2.185, 917.5, 1.0, 1, 1, 2, 0.2639642497144027),
    ('savE® OM50', 'Organic', 50.0, 50.0, 50.0, 189.0, 204.0, 55.0, 859.0, 961.0, 2.78, 3.33, 0.14, 0.21, 0.175, 12.95, 90.0, 'Yes', 200.0, 2000.0, 189000000.0, 196.5, 0.0, 188.8365, 0.6666666666666667, 3.055, 910.0, 1.0, 1, 1, 2, 0.3146996113755507),
    ('RT35', 'Organic (RT-line)', 35.0, 35.0, 35.0, 160.0, 160.0, 45.0, 770.0, 860.0, 2.0, 2.62, 0.2185, 0.2199999999999999, 0.2, 12.5, 65.0, 'Unknown', 165.0, 0.0, 160000000.0, 160.0, 0.0, 137.6, 0.9931818181818184, 2.31, 815.0, 0.0, 1, 2, 1, 0.1278388150172601),
    ('RT38', 'Organic (RT-line)', 38.0, 38.0, 38.0, 170.0, 170.0, 47.0, 750.0, 880.0, 2.0, 2.62, 0.2185, 0.2199999999999999, 0.2, 12.5, 70.0, 'Unknown', 165.0, 0.0, 170000000.0, 170.0, 0.0, 149.6, 0.9931818181818184, 2.31, 815.0, 0.0, 1, 2, 1, 0.1377859668556889),
    ('RT42', 'Organic (RT-line)', 41.0, 42.0, 42.0, 165.0, 165.0, 48.0, 760.0, 880.0, 2.0, 2.62, 0.1815, 0.2199999999999999, 0.2, 12.5, 72.0, 'Unknown', 186.0, 0.0, -165.000165000165, 165.0, -1.0, 145.2, 0.8250000000000002, 2.31, 820.0, 0.0, 1, 2, 1, 0.1314212415312789),
    ('RT44HC', 'Organic (RT-line)', 43.0, 43.0, 43.0, 250.0, 250.0, 70.0, 700.0, 800.0, 2.0, 2.774, 0.2185, 0.2209999999999999, 0.2, 12.5, 70.0, 'Unknown', 180.0, 0.0, 250000000.0, 250.0, 0.0, 200.0, 0.9886877828054303, 2.387, 750.0, 0.0, 1, 2, 1, 0.3485993016052739),
    ('RT45HC', 'Organic (RT-line)', 47.0, 45.0, 45.0, 230.0, 230.0, 64.0, 800.0, 900.0, 2.0, 2.7150000000000003, 0.2495, 0.2499999999999999, 0.2, 12.0, 75.0, 'Unknown', 155.0, 0.0, 114.99994250002874, 230.0, 2.0, 207.0, 0.9980000000000002, 2.3575, 850.0, 0.0, 1, 2, 1, 0.3059752244259068),
    ('RT47', 'Organic (RT-line)', 46.0, 47.0, 47.0, 160.0, 160.0, 46.0, 770.0, 880.0, 2.0, 2.561, 0.2495, 0.249, 0.2, 12.0, 65.0, 'Unknown', 180.0, 0.0, -160.00016000016, 160.0, -1.0, 140.8, 1.002008032128514, 2.2805, 825.0, 0.0, 1, 2, 1, 0.1279294403185343),
    ('RT50', 'Organic (RT-line)', 49.0, 50.0, 50.0, 160.0, 160.0, 46.0, 760.0, 880.0, 2.0, 2.62, 0.1815, 0.2199999999999999, 0.2, 12.5, 70.0, 'Unknown', 200.0, 0.0, -160.00016000016, 160.0, -1.0, 140.8, 0.8250000000000002, 2.31, 820.0, 0.0, 1, 2, 1, 0.1281437937721197),
    ('RT54HC', 'Organic (RT-line)', 54.0, 54.0, 54.0, 200.0, 200.0, 56.0, 850.0, 990.0, 2.0, 2.656, 0.246, 0.24, 0.2, 11.9, 85.0, 'Unknown', 171.0, 0.0, 200000000.0, 200.0, 0.0, 198.0, 1.025, 2.3280000000000003, 920.0, 0.0, 1, 2, 1, 0.2262781792250287),
    ('RT55', 'Organic (RT-line)', 55.0, 55.0, 55.0, 170.0, 170.0, 48.0, 770.0, 880.0, 2.0, 2.772, 0.1825, 0.2179999999999999, 0.2, 14.0, 90.0, 'Unknown', 200.0, 0.0, 170000000.0, 170.0, 0.0, 149.6, 0.8371559633027525, 2.386, 825.0, 0.0, 1, 2, 1, 0.1384812193500707),
    ('RT64HC', 'Organic (RT-line)', 64.0, 64.0, 64.0, 250.0, 250.0, 70.0, 800.0, 900.0, 2.0, 2.7150000000000003, 0.2125, 0.2499999999999999, 0.2, 11.0, 95.0, 'Unknown', 190.0, 0.0, 250000000.0, 250.0, 0.0, 225.0, 0.8500000000000002, 2.3575, 850.0, 0.0, 1, 2, 1, 0.3576632261889341),
]

# Eight materials in an earlier layout with the weighted min-max score.
CLEAN_V1_COLUMNS = (
    "product", "latent_heat_melting", "density_solid", "TC_both", "Cp_avg", "rho_H_MJ_m3",
    "cycles_confidence", "flammability", "is_flammable", "Tm_melting", "pcm_suitability_score",
)
CLEAN_V1 = [
    ('savE® HS36', 163, 1967.0, 0.485, 2.15, 320.621, 0.5, 'No', 0, 35.0, 0.4),
    ('savE® OM35', 171, 900.0, 0.18, 2.675, 153.9, 0.5, 'Yes', 1, 35.0, 0.1322311923262524),
    ('savE® OM37', 186, 973.0, 0.145, 2.59, 180.978, 0.5, 'No', 0, 38.0, 0.2123749818282495),
    ('savE® OM39', 229, 850.0, 0.1775, 2.2, 194.65, 0.5, 'No', 0, 39.0, 0.4660849685483845),
    ('savE® OM42', 199, 903.0, 0.145, 2.745, 179.697, 0.5, 'Yes', 1, 44.0, 0.307137408162247),
    ('savE® OM46', 177, 917.0, 0.15, 2.6, 162.309, 0.5, 'No', 0, 47.0, 0.1458143459462429),
    ('savE® OM48', 165, 960.0, 0.15, 2.185, 158.4, 0.5, 'Yes', 1, 51.0, 0.0237137661546421),
    ('savE® OM50', 189, 961.0, 0.175, 3.055, 181.629, 0.5, 'Yes', 1, 50.0, 0.3045825480679395),
]

# Best material per site and season for the eight materials above.
LABELS_COLUMNS = (
    "city", "season", "T_set", "rrtdhs_approx", "optimal_Tm_target", "best_pcm_product",
    "best_pcm_id", "best_pcm_Tm", "best_pcm_score",
)
LABELS = [
    ('Coimbatore', 'winter', 45.0, 3.5, 42.0, 'savE® OM39', 3, 39.0, 0.4660849685483845),
    ('Coimbatore', 'pre-monsoon', 45.0, 5.0, 47.0, 'savE® OM42', 4, 44.0, 0.307137408162247),
    ('Coimbatore', 'monsoon', 45.0, 2.5, 44.0, 'savE® OM39', 3, 39.0, 0.4660849685483845),
    ('Coimbatore', 'post-monsoon', 45.0, 4.25, 45.0, 'savE® OM39', 3, 39.0, 0.4660849685483845),
    ('Jaisalmer', 'winter', 55.0, 6.3, 52.0, 'savE® OM50', 7, 50.0, 0.3045825480679395),
    ('Jaisalmer', 'pre-monsoon', 55.0, 9.0, 57.0, 'savE® OM48', 6, 51.0, 0.0237137661546421),
    ('Jaisalmer', 'monsoon', 55.0, 4.5, 54.0, 'savE® OM50', 7, 50.0, 0.3045825480679395),
    ('Jaisalmer', 'post-monsoon', 55.0, 7.649999999999999, 55.0, 'savE® OM48', 6, 51.0, 0.0237137661546421),
]
